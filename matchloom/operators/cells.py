"""Scores, ranks and best scores of dense vectors in cells, without a table of all pairs.

References and partners meet in cells: a batch of references with a stretch of the partners (`whole=False`), or with all partners of one
group, or all there are, where exact ranks need them together (`whole=True`). A cell's task holds the vectors of its partners and works
through its references a few at a time, so pairs exist only as a small matrix of scores; what leaves the task is what was asked for. A
score is summed up in the order of the vector, as `stats.dot` does, and rounded as F.round does, so both give the same numbers.

Distribution: a stretch has some COLS partners and a batch some ROWS references, so tasks stay alike as the input grows and only their
number grows; the result of a stretch is a few values of each reference, summed up afterwards. With `whole` a task reads the vectors of
one group (of all partners without groups): it grows with them, not with the pairs.

Defined results: a null id, or a null group where groups must differ, pairs with nothing; rows of one id are ranked together; repeated
rows each count; NaN is the largest score, as in Spark; vectors must have one length; an empty side gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.stats import PLACES
from matchloom.sources.scratch import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

ROWS, COLS = 2048, 16384
#: References of a cell with all partners of a group.
WHOLE_ROWS = 512
#: Scores held at a time, and the columns summed up together.
HELD, TILE = 1 << 19, 8192
#: References and partners of a cell all of whose scores leave it: as many as make some CELLS cells, from the first to the second number. About so
#: many scores in a batch.
SIDES_OUT, CELLS, BATCH = (2048, 16384), 64, 1 << 16
ZERO = 5e-11


def rounded(x: np.ndarray, places: int = PLACES) -> np.ndarray:
    """F.round(x, places): half up on the shortest decimal form, which only matters next to a half."""
    y = x * 10.0**places
    near = np.rint(y)
    out = near / 10.0**places + 0.0
    for i in np.flatnonzero(np.abs(np.abs(y - near) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0
    return out


def dots(a: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """a @ bt, each sum from the first product to the last."""
    out = np.zeros((len(a), bt.shape[1]))
    part = np.empty((len(a), min(TILE, bt.shape[1])))
    for j in range(0, bt.shape[1], TILE):
        s, b = out[:, j : j + TILE], bt[:, j : j + TILE]
        t = part[:, : s.shape[1]]
        for k in range(len(b)):
            np.multiply(a[:, k, None], b[k], out=t)
            s += t
    return out


def coded(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Values as numbers in their order, the same for all columns."""
    values = [c.to_numpy() for c in columns]
    codes = np.unique(np.concatenate(values), return_inverse=True)[1]
    return np.split(codes, np.cumsum([len(v) for v in values])[:-1])


class Cell:
    """References (in the order of their ids) and partners (in the order of their groups) of a cell, as codes and matrices."""

    def __init__(self, batches: Iterator[pa.RecordBatch], groups: bool) -> None:
        rows = pa.Table.from_batches(list(batches))
        first = rows.column("_first").to_numpy(zero_copy_only=False)
        refs, pairs = rows.filter(pa.array(first)), rows.filter(pa.array(~first))
        self.empty = not (refs.num_rows and pairs.num_rows)
        if self.empty:
            return
        rid, pid = coded(refs.column("_id"), pairs.column("_id"))
        rg, pg = coded(refs.column("_grp"), pairs.column("_grp")) if groups else (np.zeros(len(rid), int), np.zeros(len(pid), int))
        r, p = np.argsort(rid, kind="stable"), np.argsort(pg, kind="stable")
        self.refs, self.pairs = refs.take(pa.array(r)), pairs.take(pa.array(p))
        self.rid, self.rg, self.pid, self.pg = rid[r], rg[r], pid[p], pg[p]
        dense = lambda t: np.asarray(t.column("_vec").combine_chunks().flatten()).reshape(t.num_rows, -1)
        self.r, self.pt = dense(self.refs), np.ascontiguousarray(dense(self.pairs).T)
        kinds: dict = {}
        self.cls = np.array([kinds.setdefault(c, len(kinds)) for c in self.refs.column("_cls").to_pylist()])
        members = self.pairs.column("_classes").combine_chunks()
        at = np.flatnonzero(np.asarray(members.is_valid()))
        own = [(col, kinds[c["c"]]) for col, cs in zip(at, members.take(pa.array(at)).to_pylist(), strict=True) for c in cs if c["c"] in kinds]
        self.member, self.of = (np.array([x[i] for x in own], dtype=np.int64) for i in (0, 1))
        self.n_kinds = len(kinds)
        self.codes = np.sort(self.member * self.n_kinds + self.of)

    def blocks(self, most: int = 16) -> Iterator[slice]:
        """Slices of references that do not cut the rows of an id."""
        step, a, n = max(1, min(most, HELD // self.pt.shape[1])), 0, len(self.rid)
        while a < n:
            b = min(n, a + step)
            while b < n and self.rid[b] == self.rid[b - 1]:
                b += 1
            yield slice(a, b)
            a = b

    def true(self, row: int, cols: np.ndarray) -> np.ndarray:
        return np.isin(cols * self.n_kinds + self.cls[row], self.codes) if len(self.codes) else np.zeros(len(cols), bool)

    def met(self, row: int, selves: bool, groups: bool) -> np.ndarray:
        ok = np.ones(len(self.pid), bool) if selves else self.pid != self.rid[row]
        return ok & (self.pg != self.rg[row]) if groups else ok


def largest(x: np.ndarray, n: int) -> np.ndarray:
    """Places of all values that round to one of the n largest distinct rounded values, and maybe of others."""
    if len(x) > 8 * n:
        floor = np.partition(x, len(x) - 4 * n)[len(x) - 4 * n]
        at = np.flatnonzero(~(x <= floor - 2 * 10.0**-PLACES))
        v = rounded(x[at])
        at = at[~(v < rounded(np.array([floor]))[0])]
        if len(np.unique(rounded(x[at]))) >= n:
            return at
    return np.arange(len(x))


def every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def batch_of(n: int) -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")


def dealt(r: DataFrame, p: DataFrame, rows: int, cols: int) -> DataFrame:
    """References in batches of some `rows` and partners in stretches of some `cols`, (_id, _vec, ...), below each other in their cells."""
    n_rows, n_cols = max(1, -(-r.count() // rows)), max(1, -(-p.count() // cols))
    stretch = F.pmod(F.xxhash64("_id", *[c for c in p.columns if c == "_vec"], F.lit(1)), F.lit(n_cols)).cast("int")
    r = r.withColumn("_i", batch_of(n_rows)).withColumn("_j", every(n_cols))
    return r.unionByName(p.withColumn("_j", stretch).withColumn("_i", every(n_rows)))


def placed(refs: DataFrame, pairs: DataFrame, groups: bool, by_group: bool, whole: bool, rows: int, cols: int) -> DataFrame:
    """References (cls, ref_id, ref_group, vec) and partners (pair_id, pair_group, vec, classes) below each other in their cells."""
    side = lambda df, first: df.select(
        F.lit(first).alias("_first"), F.col("ref_id" if first else "pair_id").alias("_id"), F.col("ref_group" if first else "pair_group").alias("_grp"), F.col("vec").cast("array<double>").alias("_vec"),
        (F.col("cls") if first else F.lit(None).cast(dict(refs.dtypes)["cls"])).alias("_cls"), (F.lit(None).cast(dict(pairs.dtypes)["classes"]) if first else F.col("classes")).alias("_classes"),
    ).where("_vec IS NOT NULL AND _id IS NOT NULL" + " AND _grp IS NOT NULL" * groups)
    r, p = side(refs, True), side(pairs, False)
    if not whole:
        return dealt(r, p, rows, cols)
    n_rows = max(1, -(-r.count() // rows))
    r = r.withColumn("_i", batch_of(n_rows))
    p = p.withColumn("_i", every(n_rows))
    if by_group:
        known = p.select(F.col("_grp").alias("_j")).distinct()
        return r.crossJoin(F.broadcast(known)).where("_j <> _grp" if groups else "true").unionByName(p.withColumn("_j", F.col("_grp")))
    return r.withColumn("_j", F.lit(0)).unionByName(p.withColumn("_j", F.lit(0)))


def top_values(refs: DataFrame, pairs: DataFrame, n: int, by_group: bool, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(cls, ref_id, ref_group[, pair_group], score_rank, n, n_true, n_ranked, top): the n best distinct scores of each reference (and
    partner group) with their dense rank (null for 0), their numbers of pairs and of true pairs, and the largest score before rounding.
    One more row of each reference (and group) with `top` and `score_rank` null has all its pairs, true pairs and pairs with a rank.

    refs: (cls, ref_id, ref_group, vec); pairs: (pair_id, pair_group, vec, classes), classes an array of struct(c) of the classes of
    which the partner is a reference. Pairs of one id or of one group do not count.
    """
    kind = dict(refs.dtypes)
    schema = f"_cls {kind['cls']}, _id {kind['ref_id']}, _grp {kind['ref_group']}, _pair_grp {dict(pairs.dtypes)['pair_group']}, value double, n long, n_true long, n_ranked long, top double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cell(batches, True)
        if c.empty:
            return
        ends = [0, *(np.flatnonzero(np.diff(c.pg)) + 1), len(c.pg)] if by_group else [0, len(c.pg)]
        out: list[tuple] = []
        for block in c.blocks():
            s = dots(c.r[block], c.pt)
            for row in range(block.start, block.stop):
                ok, x = c.met(row, False, True), s[row - block.start]
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    cols = a + np.flatnonzero(ok[a:b])
                    if not len(cols):
                        continue
                    m = c.member[(c.of == c.cls[row]) & (c.member >= a) & (c.member < b)]
                    out.append((row, a, None, len(cols), int(ok[m].sum()), int((~(np.abs(x[cols]) < ZERO)).sum()), None))
                    cols = cols[largest(x[cols], n)]
                    values, which = np.unique(rounded(x[cols]), return_inverse=True)
                    best = np.full(len(values), -np.inf)
                    np.maximum.at(best, which, x[cols])
                    count, true = np.bincount(which, minlength=len(values)), np.bincount(which, c.true(row, cols), len(values))
                    out += [(row, a, float(values[k]), int(count[k]), int(true[k]), 0, float(best[k])) for k in range(len(values) - 1, max(-1, len(values) - 1 - n), -1)]
            if len(out) > 50_000 or block.stop == len(c.rid):
                row, at, *rest = zip(*out, strict=True) if out else [()] * 7
                row, at = pa.array(row, pa.int64()), pa.array(at, pa.int64())
                own = [c.refs.column(k).combine_chunks().take(row) for k in ("_cls", "_id", "_grp")] + [c.pairs.column("_grp").combine_chunks().take(at)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(rest, (pa.float64(), *[pa.int64()] * 3, pa.float64()), strict=True))], names=["_cls", "_id", "_grp", "_pair_grp", "value", "n", "n_true", "n_ranked", "top"])
                out = []

    found = placed(refs, pairs, True, by_group, False, rows, cols).groupBy("_i", "_j").applyInArrow(run, schema)
    group = ["pair_group"] if by_group else []
    found = found.select(F.col("_cls").alias("cls"), F.col("_id").alias("ref_id"), F.col("_grp").alias("ref_group"), F.col("_pair_grp").alias("pair_group"), "value", "n", "n_true", "n_ranked", "top")
    sums = found.groupBy("cls", "ref_id", "ref_group", *group, "value").agg(F.sum("n").alias("n"), F.sum("n_true").alias("n_true"), F.sum("n_ranked").alias("n_ranked"), F.max("top").alias("top"))
    place = F.dense_rank().over(Window.partitionBy("ref_id", *group).orderBy(F.col("value").desc_nulls_last()))
    ranked = sums.withColumn("_k", place).where((F.col("_k") <= n) | F.col("value").isNull())
    return cut(ranked.select("cls", "ref_id", "ref_group", *group, F.when(F.col("value") != 0, F.col("_k")).alias("score_rank"), "n", "n_true", "n_ranked", F.when(F.col("value").isNotNull(), F.col("top")).alias("top")))


#: Columns that `pair_ranks` can give, besides a score and its rank under their own names.
KINDS = {"true_pairing": "boolean", "top": "double", "max_rank": "int"}


def ranks_of(v: np.ndarray) -> np.ndarray:
    """Dense ranks, largest first."""
    values, which = np.unique(v, return_inverse=True)
    return len(values) - which


def met_blocks(c: Cell, parts: dict[str, int | None]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(rows, columns, scores) of the pairs of one id at a time; `parts`: the first dimensions that a score is taken over."""
    for block in c.blocks():
        s = {name: dots(c.r[block, :d], c.pt[:d]) for name, d in parts.items()}
        starts = [block.start, *(block.start + 1 + np.flatnonzero(np.diff(c.rid[block]))), block.stop]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = [(np.full(len(cols), row), cols) for row in range(a, b) for cols in [np.flatnonzero(c.met(row, False, True))]]
            rows, cols = (np.concatenate([x[i] for x in own]) for i in (0, 1))
            if len(cols):
                yield rows, cols, {name: x[rows - block.start, cols] for name, x in s.items()}


def pair_ranks(refs: DataFrame, pairs: DataFrame, by_group: bool, columns: Sequence[str], parts: dict[str, int | None], cutoff: int | None = None, rows: int = WHOLE_ROWS) -> DataFrame:
    """The wanted `columns` of all pairs of different ids and groups: ref_id, pair_id, pair_group, a score of `parts`, its dense rank
    <score>_rank per reference (and partner group; null for 0), and of the first score true_pairing, top (the largest score of rank 1)
    and max_rank (the largest rank of a true pair). With `cutoff` only pairs of which the best rank is within it. Sides: see `top_values`."""
    main = next(iter(parts))
    kinds = {"ref_id": dict(refs.dtypes)["ref_id"], "pair_id": dict(pairs.dtypes)["pair_id"], "pair_group": dict(pairs.dtypes)["pair_group"]} | KINDS
    kinds |= {s: "double" for s in parts} | {f"{s}_rank": "int" for s in parts}
    need = {s for s in parts if cutoff or f"{s}_rank" in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cell(batches, True)
        if c.empty:
            return
        source = {"ref_id": c.refs.column("_id").combine_chunks(), "pair_id": c.pairs.column("_id").combine_chunks(), "pair_group": c.pairs.column("_grp").combine_chunks()}
        for rows_, cols, s in met_blocks(c, parts):
            v = {name: rounded(s[name]) for name in {*need, main}}
            rank = {name: ranks_of(v[name]) for name in need | ({main} if "max_rank" in columns else set())}
            keep = np.ones(len(cols), bool)
            if cutoff:
                keep = np.logical_or.reduce([(rank[n] <= cutoff) & (v[n] != 0) for n in rank])
            out = []
            for name in columns:
                if name in source:
                    out.append(source[name].take(pa.array((rows_ if name == "ref_id" else cols)[keep])))
                elif name in s:
                    out.append(pa.array(s[name][keep]))
                elif name == "true_pairing":
                    out.append(pa.array(truth(c, rows_, cols)[keep]))
                elif name == "top":
                    best = v[main].max()
                    out.append(pa.array(np.full(keep.sum(), s[main][(v[main] == best) | np.isnan(v[main])].max()), mask=np.full(keep.sum(), best == 0)))
                elif name == "max_rank":
                    right = rank[main][truth(c, rows_, cols) & (v[main] != 0)]
                    out.append(pa.array(np.full(keep.sum(), right.max(initial=0), np.int32), mask=np.full(keep.sum(), not len(right))))
                else:
                    of = name.removesuffix("_rank")
                    out.append(pa.array(rank[of][keep].astype(np.int32), mask=(v[of] == 0)[keep]))
            yield pa.RecordBatch.from_arrays(out, names=list(columns))

    return placed(refs, pairs, True, by_group, True, rows, COLS).groupBy("_i", "_j").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def truth(c: Cell, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.isin(cols * c.n_kinds + c.cls[rows], c.codes) if len(c.codes) else np.zeros(len(cols), bool)


def rank_differences(refs: DataFrame, pairs: DataFrame, by_group: bool, parts: dict[str, int | None], rows: int = WHOLE_ROWS) -> DataFrame:
    """(value, n): numbers of pairs by the rank in the first of two scores less that in the second, which is ranked among the pairs
    where it is not 0; pairs without one of the ranks are left out."""
    one, two = parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cell(batches, True)
        if c.empty:
            return
        low = len(c.pid) * max(1, np.bincount(c.rid).max()) + 1
        n = np.zeros(2 * low + 1, np.int64)
        for _, _, s in met_blocks(c, parts):
            v, w = rounded(s[one]), rounded(s[two])
            r, q = ranks_of(v), np.zeros(len(w), np.int64)
            q[w != 0] = ranks_of(w[w != 0])
            np.add.at(n, (r - q)[(v != 0) & (w != 0)] + low, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((at - low).astype(np.int32)), pa.array(n[at])], names=["value", "n"])

    found = placed(refs, pairs, True, by_group, True, rows, COLS).groupBy("_i", "_j").applyInArrow(run, "value int, n long")
    return found.groupBy("value").agg(F.sum("n").alias("n"))


def top_rows(refs: DataFrame, pairs: DataFrame, n: int, differ: bool, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(reference_id, paired_id, score): of each stretch of the partners the n best pairs of a reference and those that tie with the
    last of them, so the n best of a reference, ties included, are among them. `differ`: pairs of one id or one group do not count.
    Sides: see `top_values`; without `differ` the groups are not looked at."""
    schema = f"reference_id {dict(refs.dtypes)['ref_id']}, paired_id {dict(pairs.dtypes)['pair_id']}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cell(batches, differ)
        if c.empty:
            return
        for block in c.blocks():
            s = dots(c.r[block], c.pt)
            found = []
            for row in range(block.start, block.stop):
                met = np.flatnonzero(c.met(row, not differ, differ))
                found.append(met[best_places(s[row - block.start][met], n)])
            at = np.repeat(np.arange(block.start, block.stop), [len(f) for f in found])
            col = np.concatenate(found)
            ids = [t.column("_id").combine_chunks().take(pa.array(i)) for t, i in ((c.refs, at), (c.pairs, col))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(s[at - block.start, col])], names=["reference_id", "paired_id", "score"])

    return placed(refs, pairs, differ, False, False, rows, cols).groupBy("_i", "_j").applyInArrow(run, schema)


def best_places(x: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest values, and of all that round to the last of them."""
    at = largest(x, n)
    if len(at) > n:
        v = rounded(x[at])
        at = at[~(v < np.partition(v, len(v) - n)[len(v) - n])]
    return at


def laid_out(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths): the vectors as rows, filled up with zeros; the length is -1 if a vector or one of its elements is null."""
    vec = column.combine_chunks()
    values, full = vec.flatten(), np.asarray(pc.fill_null(pc.list_value_length(vec), 0))
    lengths = np.where(np.asarray(vec.is_valid()), full, -1)
    row = np.repeat(np.arange(len(vec)), full)
    out = np.zeros((len(vec), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)] = np.asarray(pc.fill_null(values, 0.0))
    lengths[row[np.asarray(values.is_null())]] = -1
    return out, lengths


def products(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, places: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, whether they are null) of all rows of `a` with all rows of `b`, one after the other; lengths as in `laid_out`."""
    s = dots(a, np.ascontiguousarray(b.T)).ravel()
    return s if places is None else rounded(s, places), ((n_a[:, None] != n_b) | (n_b < 0)).ravel()


def cells_out(n_refs: int, n_pairs: int) -> tuple[int, int]:
    """References and partners of a cell, such that a row is sent to few cells and there are some CELLS of them if the input allows."""
    least, most = SIDES_OUT
    cols = min(most, max(least, -(-n_pairs // CELLS)))
    return min(most, max(least, -(-n_refs * max(1, -(-n_pairs // cols)) // CELLS))), cols


def dense_rows(refs: DataFrame, pairs: DataFrame, vec: str = "vec", places: int | None = None, positive: bool = False, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """(reference_id, paired_id, score) of all references (doc_id, vec) with all partners, rounded if `places` is given; null ids and
    ids that are equal count like others. `positive`: only scores that are above 0 when rounded to PLACES. The score is null if a vector or one of its
    elements is null, or the lengths differ."""
    schema = f"reference_id {dict(refs.dtypes)['doc_id']}, paired_id {dict(pairs.dtypes)['doc_id']}, score double"
    side = lambda df, first: df.select(F.lit(first).alias("_first"), F.col("doc_id").alias("_ref" if first else "_pair"), F.col("doc_id").alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    r, p = side(refs, True), side(pairs, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        r, p = both.filter(both.column("_first")), both.filter(pc.invert(both.column("_first")))
        if not (r.num_rows and p.num_rows):
            return
        width = max(pc.max(pc.list_value_length(t.column("_vec"))).as_py() or 0 for t in (r, p))
        (a, n_a), (b, n_b) = (laid_out(t.column("_vec"), width) for t in (r, p))
        uneven = len(np.unique(np.concatenate([n_a, n_b]))) > 1 or n_a[0] < 0
        bt, ids = np.ascontiguousarray(b.T), [r.column("_ref").combine_chunks(), p.column("_pair").combine_chunks()]
        step = max(1, BATCH // len(b))
        for i in range(0, len(a), step):
            s = dots(a[i : i + step], bt).ravel()
            void = ((n_a[i : i + step, None] != n_b) | (n_b < 0)).ravel() if uneven else np.zeros(len(s), bool)
            at = np.flatnonzero(~(s < ZERO) & ~void) if positive else np.arange(len(s))
            row, col = np.divmod(at, len(b))
            score = s[at] if places is None else rounded(s[at], places)
            yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(row + i)), ids[1].take(pa.array(col)), pa.array(score, mask=void[at])], names=["reference_id", "paired_id", "score"])

    if rows is None or cols is None:
        rows, cols = cells_out(refs.count(), pairs.count())
    both = dealt(r.withColumn("_pair", F.lit(None).cast(dict(pairs.dtypes)["doc_id"])), p.withColumn("_ref", F.lit(None).cast(dict(refs.dtypes)["doc_id"])), rows, cols)
    return both.drop("_id").groupBy("_i", "_j").applyInArrow(run, schema)


def dense_rows_with_reverse(refs: DataFrame, pairs: DataFrame, vec: str = "vec", places: int | None = None, rows: int | None = None) -> DataFrame:
    """(reference_id, paired_id, score, score_reverse): `dense_rows`, and beside each pair the scores of the pairs with its ids swapped, as a left
    join by both ids would put them. Ids go to batches, and a cell has the references and partners of two batches, so it has the swapped
    pairs too and no table of pairs is joined. All rows of an id are in one batch, of some `rows` rows."""
    kind = {c: dict(df.dtypes)["doc_id"] for c, df in (("_ref", refs), ("_pair", pairs))}
    side = lambda df, own, other: df.select(F.lit(own == "_ref").alias("_first"), F.col("doc_id").alias(own), F.lit(None).cast(kind[other]).alias(other), F.col("doc_id").cast(kind["_ref"]).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    most = max(refs.count(), pairs.count())
    n = max(1, -(-most // rows)) if rows else max(-(-most // (SIDES_OUT[1] // 2)), min(-(-most // (SIDES_OUT[0] // 4)), 11), 1)  # 11 batches make 66 cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        ids = pc.dictionary_encode(both.column("_id").combine_chunks())
        code = np.asarray(pc.fill_null(ids.indices, -1))
        x, lengths = laid_out(both.column("_vec"), pc.max(pc.list_value_length(both.column("_vec"))).as_py() or 0)
        first, batch = both.column("_first").to_numpy(zero_copy_only=False), both.column("_own").to_numpy()
        ref_ids, pair_ids = both.column("_ref").combine_chunks(), both.column("_pair").combine_chunks()
        i, j = both.column("_i")[0].as_py(), both.column("_j")[0].as_py()

        def rows_of(refs: bool, b: int) -> np.ndarray:
            at = np.flatnonzero((first == refs) & (batch == b))
            return at[np.argsort(code[at], kind="stable")]

        for u, v in dict.fromkeys([(i, j), (j, i)]):
            r, p, r_back, p_back = rows_of(True, u), rows_of(False, v), rows_of(True, v), rows_of(False, u)
            if not (len(r) and len(p)):
                continue
            low, own = np.searchsorted(code[r_back], code[p]), np.searchsorted(code[r_back], code[p], "right")  # the references with a partner's id
            of_p = np.where(code[p] < 0, 0, own - low)
            step, a = max(1, BATCH // len(p)), 0
            while a < len(r):
                b = min(len(r), a + step)
                while b < len(r) and code[r[b]] == code[r[b - 1]]:
                    b += 1
                here = r[a:b]
                back = p_back[slice(*np.searchsorted(code[p_back], [code[here[0]], code[here[-1]] + 1]))]
                start, end = np.searchsorted(code[back], code[here]), np.searchsorted(code[back], code[here], "right")  # the partners with a reference's id
                of_r = np.where(code[here] < 0, 0, end - start)
                s, void = products(x[here], lengths[here], x[p], lengths[p], places)
                t, t_void = products(x[r_back], lengths[r_back], x[back], lengths[back], places)
                met = (of_r[:, None] * of_p).ravel()
                ends = np.cumsum(np.maximum(met, 1))
                c = 0
                while c < len(met):  # some BATCH rows at a time, all of a pair at least
                    d = max(c + 1, int(np.searchsorted(ends, (ends[c - 1] if c else 0) + BATCH, "right")))
                    pair = np.repeat(np.arange(c, d), np.maximum(met[c:d], 1))
                    row, col = np.divmod(pair, len(p))
                    nth, width = np.arange(len(pair)) - (ends[pair] - np.maximum(met[pair], 1) - (ends[c - 1] if c else 0)), np.maximum(of_r[row], 1)
                    at = np.where(met[pair] > 0, (low[col] + nth // width) * len(back) + start[row] + nth % width, 0)
                    reverse, none = (t[at], t_void[at] | (met[pair] == 0)) if len(t) else (np.zeros(len(at)), np.ones(len(at), bool))
                    yield pa.RecordBatch.from_arrays([ref_ids.take(pa.array(here[row])), pair_ids.take(pa.array(p[col])), pa.array(s[pair], mask=void[pair]), pa.array(reverse, mask=none)], names=["reference_id", "paired_id", "score", "score_reverse"])
                    c = d
                a = b

    both = side(refs, "_ref", "_pair").unionByName(side(pairs, "_pair", "_ref")).withColumn("_own", batch_of(n)).withColumn("_other", every(n))
    cell = both.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_other")
    return cell.groupBy("_i", "_j").applyInArrow(run, f"reference_id {kind['_ref']}, paired_id {kind['_pair']}, score double, score_reverse double")
