"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct k-word shingles. Documents with one set form a class (a 64-bit hash of the set and
its size), and classes with Jaccard similarity of at least 3/4 are linked; the result is the connected components.

1. One map per document gives its class, set size, a histogram of its hashes and the packed hashes. The same map counts
   the shingles that several sets of its part have; the summed counts rank the most frequent ones, all others rank as rare. Any
   common order is right for prefix filtering; this one puts frequent shingles last.
2. A set's prefix are its n - ceil(3n/4) + 1 rarest shingles, of which the first n - ceil(6n/7) + 1 are index entries:
   linked sets share a shingle that is in the prefix of the larger and among the index entries of the smaller one.
   Prefix entries meet by shingle; those of two classes that pass the length filter (4 * smaller >= 3 * larger) stay.
3. A star round where they meet: each entry tries the smallest set of its bucket and length band. A pair must pass the
   positional filter (a first common shingle at positions i, j leaves at most 1 + min(n - i - 1, m - j - 1) common ones),
   then the suffix filter (the sets cut at fixed hash values: the sum of the smaller counts bounds the overlap), and is
   verified on the sets. Links merge components, and pairs inside a component need no look from here on, so groups of near
   copies are never expanded into all pairs.
4. The entries meet once more. Linked sets share `least_votes` prefix shingles, so an entry whose class has too few entries
   for any partner it met goes, and so does a pair of which one class has too few. Shingles with at most EASY entries outside
   their largest component name their pairs, whose votes are summed; pairs with enough votes are verified, once each.
5. Crowded shingles, with more entries outside, go through further star rounds, in which an entry of the largest component is
   tried by all others, until these merge little more. Of two classes that are still apart and share a crowded shingle, one is
   outside its largest component. Those classes are broadcast with their sets, in blocks of a fixed size, one after the other; all
   classes of crowded shingles meet them on the spot, best partners first, and a pair that links found in the same task or in a
   block before have joined needs no look: at most one link is made for each merger and task. Pairs are never listed, and the result is
   exact whatever the star rounds did.

Distribution: broadcast are the table of at most FREQUENT ranks, blocks of about BUSY_ENTRIES entries and BUSY_SHINGLES shingles of
busy classes and, if counted to be within BROADCAST_ROWS, the ids of the classes whose sets are needed; beyond that, joins shuffle. Shingles known
to be frequent are spread over tasks, since they need no grouping to know that they are shared, and they and all with more than WIDE
entries go on as crowded ones, whose steps aggregate before they shuffle. A shingle that no slice of COUNTED shingles held
twice has at most one entry for each such slice. Sets are joined only for pairs that passed all other filters. The
result is written, and all other tables are deleted.

Exactness: shingles and classes are compared by 64-bit hashes, sets by 40 bits of them, or more for larger sets (32 and
the bits of the smaller histogram); two sets of 500 shingles hold one false agreement in some 4 million pairs, which counts
only if their similarity is within one shingle of the threshold.

Defined results: null, empty and word-less texts have an empty set and are linked with nothing (component: own doc_id);
1 to k-1 words are one shingle; repeated rows share class and component; a component's id is its smallest doc_id (null
only if all are null), whichever of several copies has it; a very long text is one set, made in one task; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm._spark import cut, drop, release, small_batches, written
from matchloom.llm._text import mix, ragged, shingles, text_slices
from matchloom.llm.components import components

K = 5
FREQUENT = 1 << 21  # ranked shingles; 16 bytes each go to every task
COUNTED = 1 << 22  # shingles that a task counts at once
ENTRIES = 1 << 19  # entries per task when prefixes meet
MOST_TASKS = 20_000
PAIRS_AT_ONCE = 1 << 20
HOT = 50_000  # a shingle counted in so many documents is spread over tasks
ROUNDS = 8
EASY = 64  # pairs to try per entry that need no further star round: listing a pair moves some 13 bytes, a round some 500 an entry
WIDE = 1 << 15  # entries of a token that one task may group once more
BUSY_ENTRIES = 1 << 19  # counted entries of busy classes that may be broadcast (8 MB)
BUSY_SHINGLES = 1 << 23  # counted shingles of their sets (36 MB)
BROADCAST_ROWS = 1 << 20  # counted class ids that may be broadcast (16 MB); more are joined by shuffle
LOW = np.uint64((1 << 32) - 1)


def shared_least(n: Column, m: Column) -> Column:
    """Least overlap of linked sets of n and m shingles: ceil(3 (n + m) / 7)."""
    return F.floor((3 * (n + m) + 6) / 7)


def bin_bits(n: int) -> int:
    """Bits of the histogram's bins: at most two shingles a bin on average, 256 bins at least."""
    return max(8, int(n - 1).bit_length() - 1) if n > 1 else 8


def pack(h: np.ndarray) -> tuple[bytes, bytes]:
    """Histogram by the upper bits, and the 32 bits below bit 40 + bins, of sorted hashes; `unpack` puts both together."""
    b = bin_bits(len(h))
    counts = np.bincount((h >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b).astype(np.uint8)
    return counts.tobytes(), (h >> np.uint64(32 - b) & LOW).astype("<u4").tobytes()


def unpack(sig: bytes, low: bytes, bits: int) -> np.ndarray:
    """The upper `bits` + 32 bits of each hash, `bits` being at most the histogram's."""
    counts = np.frombuffer(sig, np.uint8)
    own = len(counts).bit_length() - 1
    whole = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(32) | np.frombuffer(low, "<u4").astype(np.uint64)
    return whole >> np.uint64(own - bits)


def overlap_bound(a: bytes, b: bytes) -> int:
    """Suffix filter: sum over hash ranges of the smaller count."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def class_of(h: np.ndarray) -> int:
    """Signed 64-bit id of a set of sorted hashes."""
    up = mix(h + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(h))
    return int(mix(np.array([up], np.uint64)).view(np.int64)[0])


FEATURES = "doc_id long, cls long, n int, sig binary, low binary, shingle long, seen int"


def features(docs: DataFrame, k: int = K) -> DataFrame:
    """Rows of documents (shingle is null) and rows of slice-wise frequent shingles (cls is null and n too)."""

    names = [f.split()[0] for f in FEATURES.split(", ")]

    def counted(held: list[np.ndarray]):
        u, c = np.unique(np.concatenate(held), return_counts=True)
        often = c > 1
        m = int(often.sum())
        return pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())), pa.array(u[often].view(np.int64)), pa.array(c[often].astype(np.int32))], names=names)

    def run(batches):
        held, seen = [], set()
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in text_slices(b):
                rows, h = shingles(data, offs, k)
                n = hi - lo
                cuts = np.searchsorted(rows, np.arange(n + 1))
                sets = [h[cuts[i] : cuts[i + 1]] for i in range(n)]
                packed = [pack(s) if len(s) else (None, None) for s in sets]
                cls = [class_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
                    names=names,
                )
                for c, one in zip(cls, sets, strict=True):  # copies count once
                    if c is not None and c not in seen:
                        seen.add(c)
                        held.append(one.copy())
                if sum(map(len, held)) > COUNTED:
                    yield counted(held)
                    held, seen = [], set()
        if held:
            yield counted(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def prefix_entries(docs: DataFrame, ranks: Broadcast, k: int = K, hot: int = HOT) -> DataFrame:
    """(token, cls, np, spread): prefix entries; np = n << 32 | position; spread: where a hot token's entry goes, else the token."""
    def run(batches):
        keys, seen = ranks.value
        for b in batches:
            for lo, hi, data, offs in text_slices(b, "text"):
                rows, h = shingles(data, offs, k)
                if not len(h):
                    continue
                i = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                f = np.where(keys[i] == h, seen[i], 0) if len(keys) else np.zeros(len(h), np.int64)
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                n = np.diff(cuts)
                cls = np.array([class_of(h[cuts[j] : cuts[j + 1]]) if n[j] else 0 for j in range(hi - lo)], np.int64)
                once = np.zeros(hi - lo, bool)
                once[np.unique(cls, return_index=True)[1]] = True
                order = np.lexsort((h, f, rows))
                pos = np.arange(len(h)) - cuts[rows]
                token, f = h[order].view(np.int64), f[order]
                keep = (pos < (n - (3 * n + 3) // 4 + 1)[rows]) & once[rows]
                r = rows[keep]
                token, f, own = token[keep], f[keep], cls[r]
                spread = np.where(f >= hot, mix(own.view(np.uint64) + np.uint64(9)).view(np.int64), token)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(own), pa.array((n[r] << 32) | pos[keep]), pa.array(spread)], names=["token", "cls", "np", "spread"])

    return docs.select("text").mapInArrow(run, "token long, cls long, np long, spread long")


def overlap_prefix(n: np.ndarray) -> np.ndarray:
    """Number of index entries of a set of n shingles."""
    return n - (6 * n + 6) // 7 + 1


def fits(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length, index and positional filters on entries (size, position) of one token."""
    small, pos = np.minimum(n, m), np.where(n < m, i, np.where(m < n, j, np.maximum(i, j)))
    return (4 * small >= 3 * np.maximum(n, m)) & (pos < overlap_prefix(small)) & (1 + np.minimum(n - i - 1, m - j - 1) >= (3 * (n + m) + 6) // 7)


def least_votes(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared prefix tokens that linked sets of n and m shingles have at least. With an overlap of a, at most n - a of the
    first set's prefix are not shared; the others stand among the second's first ones, of which at most m - a are not."""
    a = (3 * (n + m) + 6) // 7
    spare = [x - (3 * x + 3) // 4 + 1 - (x - a) for x in (n, m)]
    return np.maximum(1, np.minimum(*spare))


def shared_entries(entries: DataFrame, tasks: int, wide: int = WIDE, most_tasks: int = MOST_TASKS) -> DataFrame:
    """Entries (token, cls, n, pos, need, wide) of tokens that two classes of similar size share (of hot tokens: all), each
    once; `need` is a bound on the least votes that a class with such a partner must have, and `wide` marks tokens that are
    hot or have more than `wide` entries. And, with a null token, the first star round over the other tokens: (cls, pivot,
    votes), pivots being the smallest sets of a bucket within a length band.

    A task holds the entries of its tokens, about ENTRIES of them; with more than `most_tasks` tasks of that size, fewer tasks
    get their entries in order and take them in pieces that end between tokens."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append([np.asarray(b.column(c)) for c in range(4)])
            size += b.num_rows
            if tasks > most_tasks and size >= ENTRIES:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                change = np.flatnonzero(cols[3][1:] != cols[3][:-1]) + 1
                if len(change):
                    yield from piece(*(c[: change[-1]] for c in cols))
                    cols = [c[change[-1] :] for c in cols]
                held, size = [cols], len(cols[0])
        if size:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            del held
            yield from piece(*cols)

    def piece(token, cls, both, spread):
        order = np.lexsort((cls, both >> 32, token))
        token, cls, both, spread = token[order], cls[order], both[order], spread[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, both, lone = token[fresh], cls[fresh], both[fresh], (spread != token)[fresh]
        if not len(token):
            return
        n, pos = both >> 32, both & 0xFFFFFFFF
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        number = np.cumsum(first) - 1
        key, at = number << 32 | n, np.arange(len(n))
        lo, hi = np.searchsorted(key, number << 32 | (3 * n + 3) // 4), np.searchsorted(key, number << 32 | 4 * n // 3, "right") - 1
        keep = lone | (hi > lo)
        lo, hi = np.where(lo == at, np.minimum(lo + 1, hi), lo), np.where(hi == at, np.maximum(hi - 1, lo), hi)
        need = np.where(lone, 1, np.maximum(1, np.minimum(least_votes(n, n[lo]), least_votes(n, n[hi])) - 1))
        large = lone | (np.bincount(number)[number] > wide)
        token, cls, n, pos, need, large, lone = (x[keep] for x in (token, cls, n, pos, need, large, lone))
        names = ["token", "cls", "n", "pos", "need", "wide", "pivot", "votes"]
        for lo in range(0, len(token), 1 << 18):
            at = slice(lo, lo + (1 << 18))
            size = len(token[at])
            yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(cls[at]), *(pa.array(x[at].astype(np.int32)) for x in (n, pos, need)), pa.array(large[at]), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32())], names=names)
        if not len(token):
            return
        band = np.floor(np.log(n) / np.log(4 / 3)).astype(np.int64)
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (band[1:] != band[:-1])
        pivot = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
        at = np.flatnonzero(~first & ~lone)
        at = at[fits(n[at], pos[at], n[pivot[at]], pos[pivot[at]])]
        u, v = cls[at], cls[pivot[at]]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        start = np.flatnonzero(new)
        votes = np.diff(np.append(start, len(u))).astype(np.int32)
        for lo in range(0, len(start), 1 << 18):
            s = start[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(s), pa.int64()), pa.array(u[s]), *(pa.nulls(len(s), pa.int32()) for _ in range(3)), pa.nulls(len(s), pa.bool_()), pa.array(v[s]), pa.array(votes[lo : lo + (1 << 18)])], names=names)

    dealt = entries.repartition(min(tasks, most_tasks), "spread")
    return (dealt.sortWithinPartitions("spread") if tasks > most_tasks else dealt).mapInArrow(run, "token long, cls long, n int, pos int, need int, wide boolean, pivot long, votes int")


def with_components(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Entries with the component `comp` of their class."""
    entries = entries.drop("comp")
    if comps is None:
        return entries.withColumn("comp", F.col("cls"))
    return entries.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


OPENED = "token long, cls long, n int, pos int, comp long, t int, v long, m int, votes int, fit boolean"


def opened(entries: DataFrame, easy: int = EASY) -> DataFrame:
    """Pairs (cls, v: classes in different components; n, m: sizes; votes, fit) from tokens with at most `easy` entries
    outside their largest component, with a null token; and the entries (token, cls, n, pos, comp, t) of all other tokens
    that several components share. `entries` have comp and t, the number of their class's entries: linked classes share
    `least_votes` of them, which drops nearly all chance meetings here."""
    names = [f.split()[0] for f in OPENED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

    def rows(**cols):
        size = len(cols["cls"])
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def meet(token, cls, n, pos, comp, t, wide):
        order = np.lexsort((comp, token, wide))
        token, cls, n, pos, comp, t, wide = (x[order] for x in (token, cls, n, pos, comp, t, wide))
        start = np.ones(len(token), bool)
        start[1:] = (token[1:] != token[:-1]) | (wide[1:] != wide[:-1])
        run = start.copy()
        run[1:] |= comp[1:] != comp[:-1]
        number, group = np.cumsum(start) - 1, np.cumsum(run) - 1
        size, own = np.bincount(number), np.bincount(group)
        most = np.zeros(len(size), np.int64)
        np.maximum.at(most, number[run], own)
        major = np.full(len(size), len(own))
        lead = own == most[number[run]]
        np.minimum.at(major, number[run][lead], np.flatnonzero(lead))
        minor = group != major[number]
        crowded = wide | (size - most > easy)[number]
        at = np.flatnonzero(crowded)
        for lo in range(0, len(at), 1 << 18):
            x = at[lo : lo + (1 << 18)]
            yield rows(token=token[x], cls=cls[x], n=n[x].astype(np.int32), pos=pos[x], comp=comp[x], t=t[x])
        first = np.flatnonzero(start)
        ask = np.flatnonzero(minor & ~crowded)
        ends = np.cumsum(size[number[ask]])
        lo = 0
        while lo < len(ask):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            some = ask[lo:hi]
            lo = hi
            a, b = np.repeat(some, size[number[some]]), ragged(first[number[some]], size[number[some]])
            ok = (comp[a] != comp[b]) & (~minor[b] | (cls[a] < cls[b])) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            ok = least_votes(n[a], n[b]) <= np.minimum(t[a], t[b])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            fit = fits(n[a], pos[a], n[b], pos[b])
            a, b = np.where(cls[a] > cls[b], a, b), np.where(cls[a] > cls[b], b, a)
            order = np.lexsort((cls[b], cls[a]))
            a, b, fit = a[order], b[order], fit[order]
            new = np.ones(len(a), bool)
            new[1:] = (cls[a][1:] != cls[a][:-1]) | (cls[b][1:] != cls[b][:-1])
            s = np.flatnonzero(new)
            yield rows(cls=cls[a[s]], n=n[a[s]].astype(np.int32), v=cls[b[s]], m=n[b[s]].astype(np.int32), votes=np.diff(np.append(s, len(a))).astype(np.int32), fit=np.maximum.reduceat(fit, s))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in range(8)])
            size += b.num_rows
            if size >= ENTRIES:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                change = np.flatnonzero(cols[7][1:] != cols[7][:-1]) + 1
                if len(change):
                    yield from chunk([c[: change[-1]] for c in cols])
                    cols = [c[change[-1] :] for c in cols]
                held, size = [cols], len(cols[0])
        if size:
            yield from chunk([np.concatenate(x) for x in zip(*held, strict=True)])

    def chunk(cols):
        token, cls, n, pos, comp, t, wide, _ = cols
        yield from meet(token, cls, n.astype(np.int64), pos.astype(np.int32), comp, t.astype(np.int32), wide.astype(bool))

    spread = F.when(F.col("wide"), F.xxhash64("cls", F.lit(9))).otherwise(F.col("token"))
    e = entries.select("token", "cls", "n", "pos", "comp", F.col("t").cast("int").alias("t"), "wide", spread.alias("spread"))
    return e.repartition("spread").sortWithinPartitions("spread").mapInArrow(run, OPENED)


def least_votes_column(n: Column, m: Column) -> Column:
    """`least_votes` as a column."""
    a = shared_least(n, m)
    return F.greatest(F.lit(1), F.least(*[1 + a - F.floor((3 * x + 3) / 4) for x in (n, m)]))


def voted(rows: DataFrame) -> DataFrame:
    """(u, v) of the pairs (cls, v, n, m, votes, fit) that share enough prefix entries over all rows."""
    n, m = (F.first(c).cast("long").alias(c) for c in ("n", "m"))
    pairs = rows.groupBy(F.col("cls").alias("u"), "v").agg(n, m, F.sum("votes").alias("votes"), F.max("fit").alias("fit"))
    return pairs.where(F.col("fit") & (F.col("votes") >= least_votes_column(F.col("n"), F.col("m")))).select("u", "v")


def passes(a: str, b: str) -> Column:
    """Length, index and positional filters on two entries of a token, given as struct columns with n, pos."""
    n, i, m, j = (F.col(f"{x}.{c}").cast("long") for x in (a, b) for c in ("n", "pos"))
    small_n, small_pos = F.least(n, m), F.when(n < m, i).when(m < n, j).otherwise(F.greatest(i, j))
    index = small_pos < small_n - F.floor((6 * small_n + 6) / 7) + 1
    left = 1 + F.least(n - i - 1, m - j - 1)
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & index & (left >= shared_least(n, m))


def star_pairs(entries: DataFrame, step: int) -> DataFrame:
    """(u, v, votes): each entry's class with the pivots of its buckets that belong to other components. A bucket's pivot
    is one of its largest component's entries, another one in each step."""
    e = F.struct("cls", "n", "pos", "comp")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(4 / 3)) + F.lit(0.5 * (step % 2))).cast("int")
    banded = entries.select("token", band.alias("band"), e.alias("e"))
    by_comp = banded.groupBy("token", "band", "e.comp").agg(F.count(F.lit(1)).alias("c"), F.min_by("e", F.xxhash64("e.cls", F.lit(step))).alias("p"))
    pivots = by_comp.groupBy("token", "band").agg(F.max_by("p", F.struct("c", "comp")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    tried = banded.join(pivots, ["token", "band"]).where((F.col("e.comp") != F.col("p.comp")) & passes("e", "p"))
    return tried.groupBy(F.col("e.cls").alias("u"), F.col("p.cls").alias("v")).agg(F.count(F.lit(1)).alias("votes"))


def only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, n, sig, low), one row for each class of the pairs. Their classes are broadcast if there are counted to be few."""
    needed = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    if 2 * pairs.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    return sets.select("cls", "n", "sig", "low").join(needed, "cls", "left_semi").dropDuplicates(["cls"])


def is_linked(n: int, sig: bytes, low: bytes, m: int, sig_m: bytes, low_m: bytes) -> bool:
    """Suffix filter, then the overlap of two packed sets."""
    least = -(-3 * (n + m) // 7)
    if overlap_bound(sig, sig_m) < least:
        return False
    bits = min(len(sig), len(sig_m)).bit_length() - 1
    x, y = unpack(sig, low, bits), unpack(sig_m, low_m, bits)
    return len(np.intersect1d(x, y)) >= least


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the pairs that are linked. Many pairs may have one class, as a pivot; their joins have nothing but a shuffle on
    either side, so the adaptive skew join can split them."""

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(2, 8)]
            yield b.select(["u", "v"]).filter(pa.array([is_linked(*x) for x in zip(*cols, strict=True)], pa.bool_()))

    pairs = cut(pairs.select("u", "v"))
    held = cut(only(sets, pairs))
    for s in "uv":
        side = held.select(*[F.col(c).alias(f"{c}_{s}") for c in held.columns])
        pairs = pairs.join(side, F.col(s) == F.col(f"cls_{s}")).drop(f"cls_{s}")
    return pairs.select("u", "v", "n_u", "sig_u", "low_u", "n_v", "sig_v", "low_v").mapInArrow(run, "u long, v long")


def best(pairs: DataFrame) -> DataFrame:
    """Of each u the pair with most votes."""
    return pairs.groupBy("u").agg(F.max(F.struct("votes", "v")).alias("b")).select("u", F.col("b.v").alias("v"))


def open_tokens(crowd: DataFrame) -> DataFrame:
    """(token, major, n, k): tokens that several components share, the largest one, the entries, and those outside it."""
    counts = crowd.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    return cut(counts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("k")).where("k > 0"))


def few(table: DataFrame, rows: int) -> DataFrame:
    """`table`, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def asked(crowd: DataFrame, tokens: DataFrame, n_tokens: int, sets: DataFrame, found: list[DataFrame]) -> list[DataFrame]:
    """Links (u, v) that join all components which crowded tokens show to be linked, on top of those `found`.

    Of two classes in different components that share a crowded token, one is outside the largest component. All classes of
    crowded tokens come with their sets, meet these busy ones on the spot, best partners first, and are verified there. Busy
    classes are settled once and come in blocks; between blocks the components are joined, so a pair is looked at only while apart.
    """
    own = few(tokens.select("token", "major"), n_tokens)
    busy = cut(crowd.join(own, "token").where("comp <> major").select("cls").distinct())
    theirs = crowd.join(few(busy, busy.count()), "cls", "left_semi")
    size = theirs.groupBy("cls").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    blocks = max(1, -(-size[0] // BUSY_SHINGLES), -(-size[1] // BUSY_ENTRIES))
    grouped = crowd.groupBy("cls").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.first("t").alias("t"), F.collect_list("token").alias("tokens"))
    needed = F.broadcast(grouped.select("cls")) if n_tokens <= BROADCAST_ROWS and crowd.count() <= BROADCAST_ROWS else grouped.select("cls")
    packed = sets.select("cls", "sig", "low").join(needed, "cls", "left_semi").dropDuplicates(["cls"])
    ready = cut(grouped.join(packed, "cls"))
    links: list[DataFrame] = []
    for block in range(blocks):
        part = busy.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(blocks)) == block)
        now = with_components(ready.drop("comp"), components(reduce(DataFrame.unionByName, found + links))) if links else ready
        rows = now.join(few(part, size[1] if blocks == 1 else 0), "cls", "left_semi").orderBy("cls").toArrow().to_pylist()  # a block of bounded size
        if rows:
            links.append(cut(met_on_the_spot(now, rows)))
    return links


def met_on_the_spot(ready: DataFrame, rows: list[dict]) -> DataFrame:
    """(u, v) of classes linked with those of `rows`, as long as their components are apart."""
    cls, n, comp, t = (np.array([r[c] for r in rows], np.int64) for c in ("cls", "n", "comp", "t"))
    token = np.concatenate([np.array(r["tokens"], np.int64) for r in rows])
    index = np.repeat(np.arange(len(rows)), [len(r["tokens"]) for r in rows])
    order = np.argsort(token, kind="stable")
    rest = t - np.bincount(index, minlength=len(rows))
    known = ready.sparkSession.sparkContext.broadcast((cls, n, comp, rest, token[order], index[order], [r["sig"] for r in rows], [r["low"] for r in rows]))

    def run(batches):
        b_cls, b_n, b_comp, b_rest, b_token, b_index, sigs, lows = known.value
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for b in batches:
            u, v = [], []
            for r in b.to_pylist():
                mine = np.array(r["tokens"], np.int64)
                lo, hi = np.searchsorted(b_token, mine), np.searchsorted(b_token, mine, "right")
                met, votes = np.unique(b_index[ragged(lo, hi - lo)], return_counts=True)
                m = b_n[met]
                at = int(np.searchsorted(b_cls, r["cls"]))
                known_too = at < len(b_cls) and b_cls[at] == r["cls"]
                ok = (b_comp[met] != r["comp"]) & (4 * np.minimum(m, r["n"]) >= 3 * np.maximum(m, r["n"])) & (votes + np.minimum(b_rest[met], r["t"] - len(mine)) >= least_votes(np.int64(r["n"]), m))
                if known_too:
                    ok &= met < at
                met = met[ok][np.argsort(-votes[ok], kind="stable")]
                for j in met.tolist():
                    x, y = root(r["comp"]), root(int(b_comp[j]))
                    if x != y and is_linked(r["n"], r["sig"], r["low"], int(b_n[j]), sigs[j], lows[j]):
                        up[x] = y
                        u.append(r["cls"])
                        v.append(int(b_cls[j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return ready.select("cls", "n", "comp", "t", "tokens", "sig", "low").mapInArrow(run, "u long, v long")


def frequent_shingles(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), sorted by shingle, of at most about `most` shingles with the largest counts. The count from which
    on they are taken comes from a histogram with 16 steps for each doubling."""
    counts = cut(table.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen")))
    step = F.floor(16 * F.log2(F.col("seen").cast("double")))
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["step"]):  # 16 rows for each doubling
        total += r["c"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(step >= least).toArrow()
    keys, seen = (np.asarray(got.column(c).combine_chunks()) for c in ("shingle", "seen"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], seen[order]


def link(docs: DataFrame, k: int = K, hot: int = HOT, frequent: int = FREQUENT, rounds: int = ROUNDS, easy: int = EASY) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; columns doc_id and text are read."""
    spark = docs.sparkSession
    small_batches(spark)
    table = written(features(docs, k))
    members = table.where("n IS NOT NULL")
    sets = members.where("cls IS NOT NULL")
    ranks = spark.sparkContext.broadcast(frequent_shingles(table, frequent))
    total = members.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    met = written(shared_entries(prefix_entries(docs, ranks, k, hot), max(1, -(-total // ENTRIES))))
    release(spark)
    found = [cut(verify(best(met.where("token IS NULL").groupBy(F.col("cls").alias("u"), F.col("pivot").alias("v")).agg(F.sum("votes").alias("votes"))), sets))]
    comps = components(found[0])
    per_class = Window.partitionBy("cls")
    near = with_components(met.where("token IS NOT NULL").select("token", "cls", "n", "pos", "need", "wide"), comps)
    near = written(opened(near.withColumn("t", F.count(F.lit(1)).over(per_class)).where("need <= t"), easy))
    drop(met)
    release(spark)
    crowd = near.where("token IS NOT NULL").select("token", "cls", "n", "pos", "comp", "t")
    rows = near.where("token IS NULL").select("cls", "v", "n", "m", "votes", "fit")
    tokens = open_tokens(crowd)
    last_tries = None
    for step in range(1, rounds + 1):
        n_tokens, have, tries = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0))).first()
        if tries <= easy * have or last_tries and 2 * tries > last_tries:
            break
        last_tries = tries
        more = cut(verify(best(star_pairs(crowd, step)), sets))
        if more.isEmpty():
            break
        found.append(more)
        comps = components(reduce(DataFrame.unionByName, found))
        crowd = cut(with_components(crowd, comps))
        tokens = open_tokens(crowd)
    else:
        n_tokens = tokens.count()
    if n_tokens:
        crowd = cut(crowd.join(few(tokens.select("token"), n_tokens), "token", "left_semi"))
        found += asked(crowd, tokens, n_tokens, sets, found)
        comps = components(reduce(DataFrame.unionByName, found))
    pairs = voted(rows)
    for side in "uv":
        pairs = pairs.join(comps.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left")
    pairs = pairs.where(F.coalesce("comp_u", "u") != F.coalesce("comp_v", "v"))
    found.append(cut(verify(pairs, sets)))
    comps = components(reduce(DataFrame.unionByName, found))
    first = sets.groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    own = first.join(comps, first["cls"] == comps["node"], "left").select("cls", "first_id", F.coalesce("comp", "cls").alias("comp"))
    named = own.join(own.groupBy("comp").agg(F.min("first_id").alias("component_id")), "comp").select("cls", "component_id")
    out = members.select("doc_id", "cls", "n").join(named, "cls", "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    result = written(out)
    drop(table)
    drop(near)
    return result
