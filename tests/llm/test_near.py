import random

import numpy as np
import pytest

from brute import components as brute_components
from brute import repeated
from matchloom.llm import components, ngramjoin, suffixdedup

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one  two\nthree"), (8, "a b c d e"), (9, "a b c d e f")]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)]
    base = [word() for _ in range(90)]
    rows += family(rng, base, 60, 5)
    rows += [rows[3]] * 5
    line = " ".join(f"common{i}" for i in range(12))
    rows += [line + " " + " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(30)]
    return EDGE + [(100 + i, t) for i, t in enumerate(rows)]


def linked(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"hot": 3, "frequent": 50}, {"rounds": 1}])
def test_components_agree_with_all_pairs(texts, kw):
    rows = corpus(1)
    assert linked(ngramjoin.link(texts(rows), **kw)) == sorted(brute_components(rows))


@pytest.mark.parametrize("kw", [{"rounds": 0, "easy": 2}, {"rounds": 8, "easy": 0}, {"rounds": 1, "easy": 5, "hot": 3}])
def test_crowded_tokens(texts, kw):
    rows = corpus(4)
    assert linked(ngramjoin.link(texts(rows), **kw)) == sorted(brute_components(rows))


@pytest.mark.parametrize("kw", [{"rounds": 0, "easy": 2}, {"rounds": 1, "easy": 0, "hot": 3}])
def test_crowded_tokens_whose_classes_come_in_blocks(texts, monkeypatch, kw):
    rows = corpus(2)
    old, made = ngramjoin.met_on_the_spot, []

    def counting(ready, block):
        links = ngramjoin.cut(old(ready, block))
        made.append((links.count(), len(block)))
        return links

    monkeypatch.setattr(ngramjoin, "BUSY_ENTRIES", 40)
    monkeypatch.setattr(ngramjoin, "met_on_the_spot", counting)
    assert linked(ngramjoin.link(texts(rows), **kw)) == sorted(brute_components(rows))
    assert len(made) > 1 and sum(n for n, _ in made) <= 3 * len(rows)  # in each of three tasks a link a merger at most


def test_wide_tokens_and_small_bounds(texts, monkeypatch):
    rows = corpus(7)
    old = ngramjoin.shared_entries
    monkeypatch.setattr(ngramjoin, "shared_entries", lambda e, tasks: old(e, tasks, wide=6))
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngramjoin, "ENTRIES", 64)
    assert linked(ngramjoin.link(texts(rows))) == sorted(brute_components(rows))


def test_sorted_pieces(texts, monkeypatch):
    rows = corpus(9)
    old = ngramjoin.shared_entries
    monkeypatch.setattr(ngramjoin, "shared_entries", lambda e, tasks: old(e, 9, most_tasks=2))
    monkeypatch.setattr(ngramjoin, "ENTRIES", 200)
    assert linked(ngramjoin.link(texts(rows))) == sorted(brute_components(rows))


def test_least_votes_of_sizes_between_two():
    n = np.arange(1, 400)
    for lo in (0.75, 0.8, 0.9, 1.0):
        for hi in (1.0, 1.1, 1.2, 4 / 3):
            a, b = np.ceil(lo * n).astype(np.int64), np.maximum(np.ceil(lo * n), np.floor(hi * n)).astype(np.int64)
            least = np.minimum(ngramjoin.least_votes(n, a), ngramjoin.least_votes(n, b)) - 1
            for x, y, z, w in zip(n, a, b, least, strict=True):
                assert (ngramjoin.least_votes(x, np.arange(y, z + 1)) >= w).all()


def test_very_long_texts_and_ties(texts):
    rng = random.Random(17)
    long = [f"w{rng.randint(0, 3000)}" for _ in range(40_000)]
    near, far = list(long), list(long)
    for i in rng.sample(range(len(long)), 900):
        near[i] = f"n{i}"
    for i in rng.sample(range(len(long)), 6000):
        far[i] = f"f{i}"
    eight = "a b c d e f g h i j k"  # 7 shingles; of the next text 7 of 9.33 would be needed, it has 7 of 9 and 7 of 10
    rows = [(3, " ".join(long)), (2, " ".join(near)), (1, " ".join(far)), (7, eight), (6, eight + " l m"), (9, eight + " l m n"), (8, eight)]
    assert linked(ngramjoin.link(texts(rows))) == sorted(brute_components(rows))


def test_repeated_ids_and_null_ids(texts):
    out = linked(ngramjoin.link(texts([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "")])).where("doc_id IS NOT NULL"))
    assert out == [(7, 2, 7), (7, 2, 7), (9, 0, 9)]


def test_empty_tables(texts):
    assert ngramjoin.link(texts([])).collect() == [] and suffixdedup.dedup(texts([])).collect() == []


def test_sets_pack_and_unpack():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 5000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        sig, low = ngramjoin.pack(h)
        bits = ngramjoin.bin_bits(len(h))
        assert np.array_equal(ngramjoin.unpack(sig, low, bits), h >> np.uint64(32 - bits))
        assert np.array_equal(ngramjoin.unpack(sig, low, 8), h >> np.uint64(24))
        other = np.unique(np.concatenate([h[: n // 2], rng.integers(0, 2**64, n, dtype=np.uint64)]))
        assert ngramjoin.overlap_bound(sig, ngramjoin.pack(other)[0]) >= len(np.intersect1d(h, other))


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    for at_once in (components.LINKS_AT_ONCE, 0):
        got = {r["node"]: r["comp"] for r in components.components(links, at_once).collect()}
        assert {**got, 5: 0} == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


def bytes_kept(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(300), text(210), text(90)]
    rows = [text(rng.randint(0, 500)) for _ in range(12)]
    rows += [text(rng.randint(0, 60)) + rng.choice(shared) + text(rng.randint(0, 60)) for _ in range(20)]
    rows += [rows[0]] * 3 + ["a" * 700, "ab" * 300, "ab" * 260 + "c", shared[0][:199], shared[0][:200], shared[0] * 3, "x" * 199, "x" * 199]
    return [(1, None), (2, "")] + [(10 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bound", [suffixdedup.BOUND, 2])
def test_removed_bytes_agree_with_counting(texts, bound):
    rows = passages(5)
    assert bytes_kept(suffixdedup.dedup(texts(rows), bound=bound)) == sorted(repeated(rows, 200))


@pytest.mark.parametrize("bound", [suffixdedup.BOUND, 3])
def test_repetitive_texts_agree_with_counting(texts, bound):
    rng = random.Random(12)
    block = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(1, "a" * 30_000), (2, "abcdefg" * 4000), (3, "a" * 199 + "b"), (4, "x" + "a" * 230), (5, block(150) * 90), (6, block(185) * 60 + block(300)), (7, "cdefgab" * 30), (8, "é" * 9000), (None, block(400)), (10, block(230) + "a" * 205)]
    assert bytes_kept(suffixdedup.dedup(texts(rows).where("doc_id IS NOT NULL"), bound=bound)) == sorted(repeated([r for r in rows if r[0] is not None], 200))


def test_segments_of_repetitive_texts_stay_small(texts):
    for text in (b"a" * 1_000_000, b"abcdefg" * 150_000):
        row, _, place, lo, hi, runs = suffixdedup.window_anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (hi - lo + suffixdedup.LENGTH).sum() < 1.1 * len(text) and len(row) < 40 and (hi - lo).max() < suffixdedup.PIECE
        assert lo[0] == 0 and (lo[1:] == hi[:-1] + 1).all() and hi[-1] == len(text) - suffixdedup.LENGTH and (runs > 1).all()
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 300_000).astype(np.uint8)
    _, _, _, lo, hi, runs = suffixdedup.window_anchors(text, np.array([0, len(text)]))
    assert (hi - lo + suffixdedup.LENGTH).sum() < 4 * len(text) and (runs == 1).all()
    rows = [(1, "a" * 1_000_000), (2, "abcdefg" * 150_000)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixdedup.dedup(texts(rows), bound=64).collect()}
    assert got == {1: (1_000_000, 1), 2: (1_050_000, 1)}


def test_order_is_that_of_the_strings():
    rng = random.Random(8)
    block = bytes(rng.choice(b"ab") for _ in range(30))
    data = b"".join(block + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(40)) + bytes(80)
    starts = np.arange(len(data) - 64)
    bucket = starts % 3
    order, cls = suffixdedup.deep_shallow(suffixdedup.big_endian_words(np.frombuffer(data, np.uint8)), starts, bucket, length=64, shallow=16)
    keys = [(bucket[i], data[i : i + 64]) for i in order]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:], strict=False)] == [bool(x) for x in cls[1:] == cls[:-1]]
