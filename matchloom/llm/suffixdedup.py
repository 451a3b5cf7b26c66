"""Suffix-array dedup: removes every byte covered by a string of `LENGTH` bytes that also starts anywhere else.

The suffixes that can share `LENGTH` bytes are brought together first. Each window of LENGTH bytes has an anchor: its
least GRAM-byte hash, the leftmost among equals. Equal windows have equal anchors at equal distances, so windows are
sorted in buckets of (anchor hash, distance), and a text's windows with one anchor travel together as one segment.
Anchors that occur at one place only are dropped before any text moves. Where a text repeats itself closely, as with one byte
or a short period, anchors of one hash follow each other; their windows travel as one segment of at most PIECE windows, and
distances are found again from its bytes. So segments together are at most some four times the text.

Deep-shallow sorting orders the suffixes of a bucket. Multikey quicksort splits all buckets at once by eight bytes at a
time down to SHALLOW bytes; what is still together then usually shares a long prefix and goes to blind tries: all
strings of a group are compared with one leaf, branch at the first differing word, and form the child groups by
branching place and word; a group whose strings agree to LENGTH bytes is a repeat. Neighbours in the order that agree
to LENGTH bytes are what an LCP array would show.

Distribution: places are texts, not documents, so copies of a text count once (a text with copies is covered whole).
Anchors are counted with map-side combination. An anchor with more than BOUND places (64 windows count as one) is split over
tasks by text and place; tasks then exchange digests of their distinct windows, which are counted with map-side combination as well. A task sorts segments
in chunks of WINDOWS windows that end between buckets, so memory is bounded. The result is written, and all other tables are deleted.

Exactness: texts are told apart by 64-bit hash and length; windows of a split anchor are compared across tasks by
128-bit digests, all other comparisons are of bytes. Defined results: null counts as empty; texts shorter than LENGTH
bytes lose nothing; rows with equal texts of LENGTH bytes or more lose everything, null ids and repeated rows included; a
very long text is read whole, by one task in the maps and by pieces in the sort; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import drop, release, small_batches, written
from matchloom.llm._text import binary_column, binary_parts, mix, prefix_hash, ragged, range_hash, spread, text_slices

LENGTH = 200
GRAM = 40
SHALLOW = 32
BOUND = 1 << 14
CHUNK = 4 << 20  # bytes of segments that travel in one batch
WINDOWS = 1 << 20  # windows sorted together, more if one bucket has more
PIECE = 1 << 15  # windows of one segment
U64 = np.uint64


def least_grams(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, place of the leftmost least one in the window of each start). Grams are compared by their upper 32 bits
    and ties go to the left, so equal windows choose alike wherever they stand."""
    p = prefix_hash(data, spread(256, 3))
    n = len(data) - gram + 1
    g = range_hash(p, np.arange(n), np.arange(gram, gram + n))
    key = (g >> U64(32) << U64(32)) | np.arange(n, dtype=U64)
    width, reach, m = length - gram + 1, 1, key
    while reach * 2 <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < width:
        m = np.minimum(m[: n - width + 1], m[width - reach : width - reach + n - width + 1])
    else:
        m = m[: n - width + 1]
    return g, (m & U64((1 << 32) - 1)).astype(np.int64)


def window_anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, anchor place, first start, last start, runs) of each run of windows with one anchor; runs of one
    hash that follow each other are one, cut into pieces of `piece` windows. Places count from the row's start."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(U64), none, none, none, none
    g, anchor = least_grams(data, length, gram)
    starts = len(data) - length + 1
    ok = np.zeros(starts + 1, np.int32)  # starts whose window stays in its row
    first, last = offs[:-1], offs[1:] - length
    fit = last >= first
    np.add.at(ok, first[fit], 1)
    np.add.at(ok, last[fit] + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = ok.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    inside = offs[(offs > 0) & (offs < starts)]
    new[inside] |= ok[inside]
    end = ok.copy()
    end[:-1] &= new[1:] | ~ok[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(end)
    if not len(lo):
        return none, none.astype(U64), none, none, none, none
    row, own, place = np.searchsorted(offs, lo, "right") - 1, g[anchor[lo]], anchor[lo]
    apart = np.ones(len(lo), bool)
    apart[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1]) | (lo[1:] != hi[:-1] + 1)
    at = np.flatnonzero(apart)
    runs = np.diff(np.append(at, len(lo)))
    lo, hi, row, own, place = lo[at], hi[np.append(at[1:], len(hi)) - 1], row[at], own[at], place[at]
    pieces = -(-(hi - lo + 1) // piece)
    owner = np.repeat(np.arange(len(lo)), pieces)
    lo = lo[owner] + ragged(np.zeros(len(pieces), np.int64), pieces) * piece
    hi = np.minimum(hi[owner], lo + piece - 1)
    row, own, place, runs = row[owner], own[owner], place[owner], runs[owner]
    return row, own, place - offs[row], lo - offs[row], hi - offs[row], runs


def anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(h, nb, anchor, place, lo, hi, runs) of every text; copies in one batch count once."""

    def run(batches):
        for b in batches:
            h, nb = np.asarray(b.column(0)), np.asarray(b.column(1))
            for lo, hi, data, offs in text_slices(b, "text"):
                row, a, place, first, last, runs = window_anchors(data, offs, length, gram)
                once = np.zeros(hi - lo, bool)
                once[np.unique(h[lo:hi], return_index=True)[1]] = True
                keep = once[row]
                row = row[keep] + lo
                yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(nb[row]), pa.array(a[keep].view(np.int64)), *(pa.array(x[keep].astype(np.int32)) for x in (place, first, last, runs))], names=["h", "nb", "anchor", "place", "lo", "hi", "runs"])

    return texts.select("h", "nb", "text").mapInArrow(run, "h long, nb long, anchor long, place int, lo int, hi int, runs int")


def segments(hits: DataFrame, length: int = LENGTH, bound: int = BOUND) -> DataFrame:
    """(anchor, salt, parts, h, nb, place, lo, runs, bytes): the windows of each text around its repeated anchors."""

    names = ["anchor", "salt", "parts", "h", "nb", "place", "lo", "runs", "bytes"]

    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for lo, hi, data, offs in text_slices(b, "text"):
                lists = cols["hits"].slice(lo, hi - lo)
                flat = lists.flatten()
                place, first, last, runs, anchor, seen = (np.asarray(flat.field(n)) for n in ("place", "lo", "hi", "runs", "anchor", "c"))
                row = np.repeat(np.arange(hi - lo), np.asarray(lists.value_lengths()))
                size = (last - first + length).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(size)])
                parts = np.maximum(1, -(-seen // bound)).astype(np.int32)
                h = np.asarray(cols["h"].slice(lo, hi - lo))[row]
                nb = np.asarray(cols["nb"].slice(lo, hi - lo))[row]
                salt = (mix(h.view(U64) + first.astype(U64) * U64(0x9E3779B97F4A7C15)) % parts.astype(U64)).astype(np.int32)
                a = 0
                while a < len(row):
                    z = min(a + 4096, max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1), len(row))
                    blob = data[ragged(offs[row[a:z]] + first[a:z], size[a:z])]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[a:z]) for x in (anchor, salt, parts, h, nb, place, first, runs)), binary_column(blob, ends[a : z + 1] - ends[a])], names=names)
                    a = z

    return hits.mapInArrow(run, "anchor long, salt int, parts int, h long, nb long, place int, lo int, runs int, bytes binary")


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number whose order is that of the bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    out = np.zeros(len(data), U64)
    for j in range(8):
        out |= padded[j : j + len(data)] << U64(56 - 8 * j)
    return out


def split(cls: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by class, then keys (most significant first), and whether each item in that order differs from the one before."""
    order = np.lexsort((*keys[::-1], cls))
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in (cls, *keys):
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def deep_shallow(words: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings of `length` bytes at `starts` within their buckets: (order, class), equal strings of a bucket share a class.

    `words` are the big-endian words of the text; `length` is a multiple of 8.
    """
    n = len(starts)
    order = np.argsort(bucket, kind="stable")
    lead = np.ones(n, bool)  # in `order`: the first of a class
    b = bucket[order]
    lead[1:] = b[1:] != b[:-1]

    def open_items() -> np.ndarray:
        tied = np.zeros(n, bool)
        tied[1:] = ~lead[1:]
        tied[:-1] |= ~lead[1:]
        return np.flatnonzero(tied)

    for d in range(0, min(shallow, length), 8):  # multikey quicksort, one eight-byte character deeper each time
        at = open_items()
        if not len(at):
            break
        own = order[at]
        o, new = split(np.cumsum(lead[at]), words[starts[own] + d])
        order[at] = own[o]
        lead[at] = new
    at = open_items()
    depth = np.full(len(at), min(shallow, length))
    while len(at):  # one level of all blind tries
        own = order[at]
        cls = np.cumsum(lead[at])
        first = np.searchsorted(cls, cls)
        leaf = own[first]
        lcp = np.full(len(at), length)
        live = np.arange(len(at))
        d = depth.copy()
        while len(live):
            same = words[starts[own[live]] + d[live]] == words[starts[leaf[live]] + d[live]]
            lcp[live[~same]] = d[live[~same]]
            d[live] += 8
            live = live[same]
            live = live[d[live] < length]
        apart = lcp < length
        here, there = np.zeros(len(at), U64), np.zeros(len(at), U64)
        here[apart] = words[starts[own[apart]] + lcp[apart]]
        there[apart] = words[starts[leaf[apart]] + lcp[apart]]
        side = np.where(~apart, 1, np.where(here < there, 0, 2))
        o, new = split(cls, side, np.where(side == 2, -lcp, lcp), here)
        order[at] = own[o]
        lead[at] = new
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        more = np.repeat(size > 1, size) & apart[o]
        depth = (lcp[o] + 8)[more]
        at = at[more]
        done = depth >= length
        at, depth = at[~done], depth[~done]
    return order, np.cumsum(lead)


FOUND = "h long, nb long, a int, b int, d1 long, d2 long, lone boolean"


def repeats(parts: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = WINDOWS) -> DataFrame:
    """Covered spans (h, nb, a, b; d1 is null) and, of split anchors, each distinct window's digest with a place (b = a + length)."""
    tables = spread(256, 21), spread(256, 22)

    def sort_chunk(anchor, salt, parts_, h, nb, place, lo, runs, data, offs):
        group = np.cumsum(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]))
        o = np.lexsort((lo, nb, h, group))
        once = np.ones(len(o), bool)
        once[1:] = (group[o][1:] != group[o][:-1]) | (h[o][1:] != h[o][:-1]) | (nb[o][1:] != nb[o][:-1]) | (lo[o][1:] != lo[o][:-1])
        seg = o[once]
        wins = (np.diff(offs)[seg] - length + 1).astype(np.int64)
        starts = ragged(offs[seg], wins)
        owner = np.repeat(np.arange(len(seg)), wins)
        shift = ragged(np.zeros(len(seg), np.int64), wins)
        rel = place[seg][owner] - lo[seg][owner] - shift
        several = runs[seg][owner] > 1
        if several.any():  # each window's own anchor is found again
            s = seg[runs[seg] > 1]
            size = np.diff(offs)[s].astype(np.int64)
            _, near = least_grams(data[ragged(offs[s], size)], length, gram)
            begin = ragged(np.cumsum(size) - size, size - length + 1)
            rel[several] = near[begin] - begin
        order, cls = deep_shallow(big_endian_words(data), starts, group[seg][owner] * (length + 1) + rel, length)
        count = np.bincount(cls)
        again = np.zeros(len(starts), bool)
        again[order] = count[cls] > 1
        edge = again.copy()
        edge[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
        tail = again.copy()
        tail[:-1] &= ~again[1:] | (owner[1:] != owner[:-1])
        a, z = np.flatnonzero(edge), np.flatnonzero(tail)
        s = seg[owner[a]]
        m = len(a)
        yield [pa.array(h[s]), pa.array(nb[s]), pa.array((lo[s] + shift[a]).astype(np.int32)), pa.array((lo[s] + shift[z] + length).astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_())]
        first = np.ones(len(cls), bool)
        first[1:] = cls[1:] != cls[:-1]
        rep = order[first]
        rep = rep[parts_[seg[owner[rep]]] > 1]
        if len(rep):
            s = seg[owner[rep]]
            at = starts[rep]
            d = [range_hash(prefix_hash(data, t), at, at + length).view(np.int64) for t in tables]
            w = (lo[s] + shift[rep]).astype(np.int32)
            yield [pa.array(h[s]), pa.array(nb[s]), pa.array(w), pa.array(w + np.int32(length)), pa.array(d[0]), pa.array(d[1]), pa.array(~again[rep])]

    def run(batches):
        names = ["h", "nb", "a", "b", "d1", "d2", "lone"]
        held, blobs = None, None

        def flush(upto):
            nonlocal held, blobs
            data, offs = blobs
            part = [c[:upto] for c in held]
            for out in sort_chunk(*part, data[: offs[upto]], offs[: upto + 1]):
                yield pa.RecordBatch.from_arrays(out, names=names)
            held = [c[upto:] for c in held]
            blobs = data[offs[upto] :], offs[upto:] - offs[upto]

        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(8)]
            data, offs = binary_parts(b.column(8))
            if held is None:
                held, blobs = cols, (data, offs)
            else:
                held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
                blobs = np.concatenate([blobs[0], data]), np.concatenate([blobs[1], offs[1:] + blobs[1][-1]])
            while len(blobs[0]) - (length - 1) * len(held[0]) > chunk:
                change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
                if not len(change):
                    break
                fit = change[blobs[1][change] - (length - 1) * change <= chunk]
                yield from flush(int(fit[-1] if len(fit) else change[0]))
        if held is not None and len(held[0]):
            yield from flush(len(held[0]))

    return parts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(run, FOUND)


def kept(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from doc_id, text and spans (array of a, b; may be null)."""

    def run(batches):
        for b in batches:
            n_bytes, gone, runs, sha = [], [], [], []
            spans = b.column(2).to_pylist()
            for lo, hi, data, offs in text_slices(b, "text"):
                raw = data.tobytes()
                for i in range(lo, hi):
                    text = raw[offs[i - lo] : offs[i - lo + 1]]
                    digest, at, removed, n = hashlib.sha256(), 0, 0, 0
                    for s in sorted(spans[i] or (), key=lambda x: (x["a"], x["b"])):
                        if s["a"] > at or n == 0:
                            digest.update(text[at : s["a"]])
                            n, removed, at = n + 1, removed + s["b"] - s["a"], s["b"]
                        elif s["b"] > at:
                            removed, at = removed + s["b"] - at, s["b"]
                    digest.update(text[at:])
                    n_bytes.append(len(text))
                    gone.append(removed)
                    runs.append(n)
                    sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bound: int = BOUND) -> DataFrame:
    """(h, nb, spans) of the texts that lose bytes, written. `docs`: h, nb, text."""
    spark = docs.sparkSession
    found = written(anchors(docs.where(F.col("nb") >= length), length, gram))
    place = F.struct("h", "nb", "place")
    many = F.greatest(F.count(F.lit(1)), F.floor(F.sum(F.col("hi") - F.col("lo") + 1) / 64))
    again = written(found.groupBy("anchor").agg(many.alias("c"), F.min(place).alias("x"), F.max(place).alias("y"), F.max("runs").alias("r")).where("x <> y OR r > 1").select("anchor", "c"))
    release(spark)
    # both sides of the join are shuffled, so the adaptive skew join splits hot anchors
    hits = written(found.join(again, "anchor").groupBy("h", "nb").agg(F.collect_set(F.struct("place", "lo", "hi", "runs", "anchor", "c")).alias("hits")))  # as many as a text has
    drop(found)
    drop(again)
    release(spark)
    one = docs.where(F.col("nb") >= length).dropDuplicates(["h", "nb"])
    out = written(repeats(segments(one.join(hits, ["h", "nb"]).select("h", "nb", "text", "hits"), length, bound), length, gram))
    drop(hits)
    release(spark)
    spans = out.where("d1 IS NULL").select("h", "nb", "a", "b")
    windows = out.where("d1 IS NOT NULL")
    twice = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spans = spans.unionByName(windows.where("lone").join(twice, ["d1", "d2"]).select("h", "nb", "a", "b"))
    copies = docs.groupBy("h", "nb").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("nb") >= length)).select("h", "nb", F.lit(0).alias("a"), F.col("nb").cast("int").alias("b"))
    merged = written(spans.unionByName(copies).groupBy("h", "nb").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    drop(out)
    return merged


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bound: int = BOUND) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("nb"))
    spans = covered(keyed.select("h", "nb", "text"), length, gram, bound)
    release(docs.sparkSession)
    result = written(kept(keyed.join(spans, ["h", "nb"], "left")))
    drop(spans)
    return result
