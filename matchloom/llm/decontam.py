"""Benchmark decontamination: rare word-pair seeds, a lossless count filter, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. The pairs of an item are its words that stand side by side
or one word apart, found in the documents side by side or one word apart; how often an item leaked plays no part. An
alignment at the threshold holds pairs of a weight `need` of the item's weight W, so it holds one of any pairs weighing more than
W - need: the item's seeds are its rarest such pairs, by the number of items with a pair. A text meets an item only through a
seed, however often its words stand there; the item then needs pairs of weight `need` among the text's distinct ones. Just for
the items left, all hits are listed; those on nearby diagonals are gathered into passages, and each passage is aligned with its item
word by word (match +2, mismatch -1, gap -1). The score is the best local alignment divided by a full match; pairs at or
above `threshold` are contaminated, which covers paraphrased and edited copies.

Nothing at or above the threshold is missed. Of an alignment's m matches, next ones with at most one word between on
either side are a hit; the others cost 2 or more. So its score is at most 2 + 2 x (hits side by side in both) + (other hits), its hits lie within
2 x (1 - threshold) x length diagonals, and only passages whose hits reach the score needed are aligned. A passage is
aligned with that many words on either side, which holds the whole alignment. This asks for 2 x threshold x length > 2,
true of 4 words at thresholds above 0.25.

Distribution: one map over whole texts; nothing is shuffled. Items are taken in blocks of at most `block_words` words, so
what is sent to the executors has a fixed bound; more blocks mean more passes. Hits are held for at most HITS, or one text with one
item, at a time. Alignment costs are linear in the hits: a passage holds each hit once.

Defined results: null or empty texts and items match nothing; an item shorter than n words is one seed and must stand
whole; an item found several times in a document gives one row with its best passage (the first and last word of the best
alignment, punctuation apart; n_seeds counts the hits of all its passages); repeated rows give repeated results; an empty table on either side
gives an empty result; extra columns are ignored, whatever their names. A very long text is searched whole; its passages are
aligned in batches of at most CELLS table cells a row, or one passage. Among equal scores the passage that starts first counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import small_batches
from matchloom.llm._text import mix, punctuation_table, ragged, spread, text_slices, word_hashes

N = 4
THRESHOLD = 0.4
BLOCK_WORDS = 1 << 20
HITS = 1 << 21
CELLS = 1 << 20
SCHEMA = "doc_id long, item_id long, n_seeds int, score double, first_word int, last_word int"


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    h, rows, _, _ = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offs, between=punctuation_table())
    return np.split(h, np.searchsorted(rows, np.arange(1, len(raw)))) if raw else []


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every k-gram inside a row."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = spread(k, 77)
    s = np.full(m, k, np.uint64)
    for j in range(k):
        s += h[j : j + m] * c[j]
    at = np.flatnonzero(rows[:m] == rows[k - 1 :])
    return at, mix(s[at])


def links(h: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every word with the word `step` places on in its row."""
    if len(h) <= step:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = spread(2, 99)
    at = np.flatnonzero(rows[:-step] == rows[step:])
    return at, mix(h[at] * c[0] + h[at + step] * c[1])


def seeds(h: np.ndarray, rows: np.ndarray, steps: tuple[int, ...], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, whether a word is skipped) of the word pairs at `steps` and of the whole grams of `lengths`."""
    parts = [(*links(h, rows, s), s > 1) for s in steps] + [(*grams(h, rows, k), False) for k in lengths]
    return tuple(np.concatenate(x) for x in ([p[0] for p in parts], [p[1] for p in parts], [np.full(len(p[0]), p[2]) for p in parts]))


def item_index(words: list[np.ndarray], n: int, threshold: float) -> dict:
    """Seeds of all items, sorted by hash, with what an alignment at the threshold must hold."""
    lens = np.array([len(w) for w in words])
    parts = [seeds(w, np.zeros(len(w), np.int64), *(((1, 2), ()) if len(w) >= n else ((), (len(w),)))) for w in words]
    at, g, loose = (np.concatenate(x) for x in zip(*parts, strict=True))
    item = np.repeat(np.arange(len(words)), [len(p[0]) for p in parts])
    known, number = np.unique(g, return_inverse=True)
    need = np.where(lens >= n, np.maximum(np.ceil(2 * threshold * lens - 2 - 1e-9), 1), 1).astype(np.int64)
    weight = np.where(loose, 1, 2)
    holders = np.bincount(np.unique(number * len(words) + item) // len(words), minlength=len(known))
    order = np.lexsort((number, -holders[number], item))  # each item's commonest pairs first
    upto = np.cumsum(weight[order])
    own = np.searchsorted(item[order], np.arange(len(words) + 1))
    upto -= np.repeat(np.concatenate([[0], upto])[own[:-1]], np.diff(own))
    rare = upto >= need[item[order]]  # the commonest pairs alone weigh less than needed
    seed = np.unique(number[order][rare] * len(words) + item[order][rare])
    span = np.maximum(np.floor(2 * (1 - threshold) * lens + 1e-9), 0).astype(np.int64)
    short = tuple(int(k) for k in np.unique(lens[lens < n]))
    by_item = np.argsort(item, kind="stable")
    return {"known": known, "seed_ends": np.searchsorted(seed, np.arange(len(known) + 1) * len(words)), "seed_item": seed % len(words), "own": own, "pair": number[by_item], "at": at[by_item], "loose": loose[by_item], "words": words, "lens": lens, "need": need, "span": span, "short": short, "steps": (1, 2) if (lens >= n).any() else (), "threshold": threshold}


def lookup(h: np.ndarray, rows: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, number in `known`, whether a word is skipped) of every seed in the rows, by position."""
    known = index["known"]
    at, g, loose = seeds(h, rows, index["steps"], index["short"])
    i = np.minimum(np.searchsorted(known, g), len(known) - 1)
    hit = np.flatnonzero(known[i] == g)
    hit = hit[np.argsort(at[hit], kind="stable")]
    return at[hit], i[hit], loose[hit]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local alignment score of each item with its passage, the passage's word it ends with); rows of the table are
    computed for all pairs at once."""
    if not items:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, m = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), n), np.uint64)
    b = np.ones((len(items), m), np.uint64)
    real = np.zeros((len(items), m), bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)] = x
        b[i, : len(y)] = y
        real[i, : len(y)] = True
    step = np.arange(m)
    h = np.zeros((len(items), m + 1), np.int32)
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    lens = np.array([len(x) for x in items])
    for i in range(n):
        t = h[:, :-1] + np.where((a[:, i : i + 1] == b) & real, 2, -1)
        np.maximum(t, h[:, 1:] - 1, out=t)
        np.maximum(t, 0, out=t)
        t = np.maximum.accumulate(t + step, axis=1) - step
        h[:, 1:] = np.maximum(t, 0)
        at = h.argmax(1)
        top = h[np.arange(len(h)), at]
        more = (i < lens) & (top > best)
        best[more], end[more] = top[more], at[more] - 1
    return best, end


def batches_of(sizes: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """Ranges of ascending sizes whose padded table rows have at most `cells` cells, or one passage."""
    out, lo = [], 0
    while lo < len(sizes):
        hi = lo + 1
        while hi < len(sizes) and (hi + 1 - lo) * int(sizes[hi]) <= cells and hi - lo < 256:
            hi += 1
        out.append((lo, hi))
        lo = hi
    return out


def chunks(n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges whose numbers sum to at most HITS, or of one number."""
    sums, out, lo = np.cumsum(n), [], 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + HITS, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def strong(pair: np.ndarray, diag: np.ndarray, weight: np.ndarray, need: np.ndarray, span: np.ndarray, width: int) -> np.ndarray:
    """Which hits, sorted by pair and diagonal, lie in a range of `span` diagonals whose weights sum to `need`."""
    key = pair * width + diag
    sums = np.concatenate([[0], np.cumsum(weight)])
    end = np.searchsorted(key, key + span, "right")
    start = np.flatnonzero(sums[end] - sums[:-1] >= need)
    cover = np.zeros(len(key) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.subtract.at(cover, end[start], 1)
    return np.cumsum(cover[:-1]) > 0


def met_items(present: np.ndarray, index: dict) -> np.ndarray:
    """row x items + item of those met by a seed whose pairs in the row weigh enough. present: row x pairs + pair, ascending."""
    n_items, n_pairs = len(index["lens"]), len(index["known"])
    row, pair = present // n_pairs, present % n_pairs
    n = index["seed_ends"][pair + 1] - index["seed_ends"][pair]
    some = np.flatnonzero(n)
    row, pair, n = row[some], pair[some], n[some]
    met = [np.unique(np.repeat(row[a:b], n[a:b]) * n_items + index["seed_item"][ragged(index["seed_ends"][pair[a:b]], n[a:b])]) for a, b in chunks(n)]
    met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
    out = []
    for a, b in chunks(np.diff(index["own"])[met % n_items]):
        part = met[a:b]
        owner, entry = entries(part, index)
        held = is_in(part[owner] // n_items * n_pairs + index["pair"][entry], present)
        weight = np.bincount(owner[held], np.where(index["loose"][entry[held]], 1, 2), len(part))
        out.append(part[weight >= index["need"][part % n_items]])
    return np.concatenate(out) if out else met


def entries(met: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(place in `met`, pair of its item) of every pair of the items met."""
    item = met % len(index["lens"])
    size = np.diff(index["own"])[item]
    return np.repeat(np.arange(len(met)), size), ragged(index["own"][item], size)


def is_in(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def matches(h: np.ndarray, rows: np.ndarray, where: np.ndarray, which: np.ndarray, loose: np.ndarray, index: dict) -> list[tuple[int, int, int, float, int, int]]:
    """(row, item number, seeds, score, first word, last word) of the pairs above the threshold in one slice."""
    if not len(where):
        return []
    n_items, n_pairs = len(index["lens"]), len(index["known"])
    key = rows[where].astype(np.int64) * n_pairs + which
    order = np.argsort(key, kind="stable")
    present, begin, times = np.unique(key[order], return_index=True, return_counts=True)
    met = met_items(present, index)
    owner, entry = entries(met, index)
    at = np.minimum(np.searchsorted(present, met[owner] // n_items * n_pairs + index["pair"][entry]), len(present) - 1)
    held = present[at] == met[owner] // n_items * n_pairs + index["pair"][entry]
    owner, entry, at = owner[held], entry[held], at[held]
    total = np.bincount(owner, times[at], len(met)).astype(np.int64)
    first = np.searchsorted(owner, np.arange(len(met) + 1))
    out = []
    for a, b in chunks(total):
        x = slice(first[a], first[b])
        n = times[at[x]]
        hit = order[ragged(begin[at[x]], n)]
        out += chunk_matches(h, rows, where[hit], np.repeat(entry[x], n), loose[hit], np.repeat(met[owner[x]] % n_items, n), index)
    return out


def chunk_matches(h: np.ndarray, rows: np.ndarray, at: np.ndarray, slot: np.ndarray, loose: np.ndarray, item: np.ndarray, index: dict) -> list[tuple[int, int, int, float, int, int]]:
    """The same from hits: word number, pair of the item, whether a word is skipped, item."""
    if not len(at):
        return []
    first = np.searchsorted(rows, np.arange(rows[-1] + 2))
    row, diag = rows[at], at - index["at"][slot]
    weight = np.where(loose | index["loose"][slot], 1, 2)
    most = int(index["lens"].max())
    width = len(h) + 4 * most + 4  # diagonals of one pair and a span never reach the next pair
    pair, diag = row * len(index["lens"]) + item, diag + most
    order = np.argsort(pair * width + diag, kind="stable")
    pair, diag, weight = pair[order], diag[order], weight[order]
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    size = np.diff(np.append(start, len(pair)))
    few = np.repeat(np.add.reduceat(weight, start), size) < index["need"][pair % len(index["lens"])]
    pair, diag, weight = pair[~few], diag[~few], weight[~few]
    item = pair % len(index["lens"])
    held = strong(pair, diag, weight, index["need"][item], index["span"][item], width)
    if not held.any():
        return []
    pair, item, diag = pair[held], item[held], diag[held] - most
    row = pair // len(index["lens"])
    long, span = index["lens"][item], index["span"][item]
    new = np.ones(len(row), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (diag[1:] - diag[:-1] > span[1:])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(row))
    lo = np.maximum(diag[start] - span[start], first[row[start]])
    hi = np.minimum(diag[end - 1] + long[start] + span[start], first[row[start] + 1])
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    by_size = np.lexsort((long[start], hi - lo))
    for c, z in batches_of((hi - lo)[by_size]):
        part = by_size[c:z]
        words, passages = [index["words"][item[start[i]]] for i in part], [h[lo[i] : hi[i]] for i in part]
        got, ends = align(words, passages)
        good = np.flatnonzero(got / (2 * long[start][part]) >= index["threshold"])
        back = np.zeros(len(part), np.int64)  # the same alignments from their ends, which gives their first words
        back[good] = align([words[g][::-1] for g in good], [passages[g][: ends[g] + 1][::-1] for g in good])[1]
        for i, s, e, r in zip(part, got, ends, back, strict=True):
            key = (int(row[start[i]]), int(item[start[i]]))
            score = float(s) / (2 * int(long[start[i]]))
            seen = best.get(key, (-1.0, 0, 0, 0))
            seeds = seen[3] + int(end[i] - start[i])
            last = int(lo[i] - first[key[0]] + e)
            at = (last - int(r), last)
            best[key] = (score, *at, seeds) if (score, -at[0]) > (seen[0], -seen[1]) else (*seen[:3], seeds)
    return [(r, i, n, round(s, 4), a, b) for (r, i), (s, a, b, n) in sorted(best.items()) if s >= index["threshold"]]


def one_block(docs: DataFrame, ids: list[int], texts: list[str | None], n: int, threshold: float) -> DataFrame:
    index = item_index(item_words(texts), n, threshold)
    between = punctuation_table()

    def find(batches):
        for b in batches:
            for lo, _, data, offs in text_slices(b):
                h, rows, _, _ = word_hashes(data, offs, between=between)
                if len(h):
                    got = matches(h, rows, *lookup(h, rows, index), index)
                    if got:
                        r, i, *rest = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + x for x in r])), pa.array([ids[x] for x in i], pa.int64()), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True))], names=["doc_id", "item_id", "n_seeds", "score", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, SCHEMA)


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_seeds, score, first_word, last_word) of every document that holds a test item."""
    small_batches(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text") + 1).alias("n")).first()["n"] or 0  # at least twice the words
    blocks = max(1, -(-total // (2 * block_words)))
    out = None
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))  # a block of bounded size
        rows = [r for r, w in zip(rows, item_words([r["text"] for r in rows]), strict=True) if len(w)]
        if rows:
            found = one_block(docs, [r["item_id"] for r in rows], [r["text"] for r in rows], n, threshold)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out
