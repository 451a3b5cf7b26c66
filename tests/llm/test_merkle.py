import hashlib
import zlib
from collections import defaultdict

import pytest

from matchloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, pos string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in by[s]])
    crown = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = way(trees[s], i) + way(crown, j)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            d = leaf(r, r[1].replace("\n", "") if changed else r[1])
            for a, b in steps:
                d = sha(a + d + b)
            root = crown[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], root, sha("".join(a + b for a, b in steps)), d, d == root))
    return sorted(out, key=str)


def made(n_sources=5, n=40):
    rows = [(i, f"line {i}\nsecond é\n" if i % 3 else "one line", "en" if i % 2 else None, f"src{i % n_sources}" if i % 4 else "src0", 10 * i, 7, "x") for i in range(n)]
    rows += [(n, None, None, None, None, 7, "x"), (None, "a\nb", "de", None, 3, 7, "x"), (n + 1, "", "de", "", 0, 7, "x"), (n + 2, "long\n" * 5000, "de", "Ä", 25000, 7, "x")]
    return rows + [rows[5], rows[5], (5, "another text of this id\n", "en", "src0", 1, 7, "x")]


@pytest.mark.parametrize("depth", [1, 2, merkle.DEPTH])
def test_roots_proofs_and_tampering_equal_plain_trees(spark, depth):
    rows = made()
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), depth).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_a_source_of_many_blocks_and_many_sources(spark):
    rows = [(i, f"t{i}\n", "en", "a" if i < 90 else f"b{i}", i, 7, "x") for i in range(130)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), 1).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_one_row_is_its_own_root_and_no_rows_give_none(spark):
    rows = [(1, "x", "en", "a", 1, 7, "x")]
    (only,) = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == sha("")
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
