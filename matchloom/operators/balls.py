"""Exact best n of dense vectors of length one, by balls of vectors and bounds on the angle.

A bounded number of vectors are centres; every vector goes to its nearest one. A ball is cut into shells of equal numbers of rows by
the angle to its centre, and a shell is a block: its rows lie at angles lo..hi from the centre, so a reference at angle t from the
centre is at least max(0, lo - t, t - hi) away from all of them. Each reference first meets its most promising blocks; its n-th best
score then rules out all blocks whose bound stays below. Blocks are matrices that meet references in batches, a product for each.

Distribution: one map finds centres; shells come from a range-sorted scan, so a ball with any share of the rows is many blocks; the
table of bounds has a row for each reference and block. Blocks of the second step are joined to batches of references by block.

Defined results: null vectors are left out; vectors must have length one (a zero vector meets all at 0); ties go by id; an empty side
gives an empty result; repeated rows are each scored.
"""

from __future__ import annotations

import sys

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.scan import scanned
from matchloom.operators.scoring import PLACES
from matchloom.sources.scratch import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

CENTRES = 256
ROWS = 512
BATCH = 256
SLACK = 1e-9


@dataclass(frozen=True)
class BallTop:
    """scores: (reference_id, paired_id, score). work: (step, blocks): pairs of reference and block in all, met first, met later."""

    scores: DataFrame
    work: DataFrame


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def angles(vectors: DataFrame, centres: np.ndarray, nearest: bool) -> DataFrame:
    """(doc_id, vec, c, angle) to the nearest centre, or to each."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                t = np.arccos(np.clip(matrix(b.column(1)) @ centres.T, -1, 1))
                c = t.argmin(1)[:, None] if nearest else np.broadcast_to(np.arange(len(centres)), t.shape)
                row = np.repeat(np.arange(len(t)), c.shape[1])
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(2)), pa.array(c.ravel().astype(np.int32)), pa.array(np.take_along_axis(t, c, 1).ravel())], names=["doc_id", "vec", "c", "angle"])

    kind = dict(vectors.dtypes)["doc_id"]
    return vectors.select("doc_id", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL").mapInArrow(run, f"doc_id {kind}, vec array<double>, c int, angle double")


def balls(vectors: DataFrame, centres: np.ndarray, rows: int = ROWS) -> DataFrame:
    """(c, shell, lo, hi, size, ids, vecs) of the blocks."""
    near = scanned(angles(vectors, centres, True), [F.col("angle"), F.col("doc_id")], ["c"], "place")
    shells = near.withColumn("shell", F.floor((F.col("place") - 1) / rows)).groupBy("c", "shell")
    packed = shells.agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("size"), F.collect_list(F.struct("doc_id", "vec")).alias("x"))
    return packed.select("c", "shell", "lo", "hi", "size", F.col("x.doc_id").alias("ids"), F.col("x.vec").alias("vecs"))


def met(wanted: DataFrame, refs: DataFrame, blocks: DataFrame, n: int, parts: int) -> DataFrame:
    """(reference_id, paired_id, score): of each wanted (reference_id, c, shell) the n best rows of the block."""
    own = wanted.join(refs.select(F.col("doc_id").alias("reference_id"), "vec"), "reference_id")
    batches = own.groupBy("c", "shell", F.pmod(F.xxhash64("reference_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("reference_id", "vec")).alias("r"))
    both = batches.join(blocks, ["c", "shell"]).select(F.col("r.reference_id").alias("refs"), F.col("r.vec").alias("r"), "ids", "vecs")
    kinds = {c: dict(both.dtypes)[c][6:-1] for c in ("refs", "ids")}

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                refs_, r, ids, vecs = (b.column(k)[i].values for k in range(4))
                score = matrix(r) @ matrix(vecs).T
                order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable"), score.shape), -np.round(score, PLACES)), axis=1)[:, :n]
                row = np.repeat(np.arange(len(score)), order.shape[1])
                yield pa.RecordBatch.from_arrays([refs_.take(pa.array(row)), ids.take(pa.array(order.ravel())), pa.array(np.take_along_axis(score, order, 1).ravel())], names=["reference_id", "paired_id", "score"])

    return both.mapInArrow(run, f"reference_id {kinds['refs']}, paired_id {kinds['ids']}, score double")


def best(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("reference_id").orderBy(F.round("score", PLACES).desc(), "paired_id")
    return scores.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def ball_top(refs: DataFrame, vectors: DataFrame, n: int, centres: int = CENTRES, rows: int = ROWS) -> BallTop:
    """The n best vectors of each of a stated set of references; both (doc_id, vec), ids of the references distinct."""
    refs = refs.select("doc_id", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    some = vectors.where("vec IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), F.col("vec").cast("array<double>").alias("vec")).orderBy("h").limit(centres).toArrow()  # a bounded number
    middle = matrix(some.column("vec"))
    if not len(middle):
        empty = refs.select(F.col("doc_id").alias("reference_id")).crossJoin(vectors.limit(0).select(F.col("doc_id").alias("paired_id"))).withColumn("score", F.lit(0.0)).limit(0)
        return BallTop(empty, refs.sparkSession.createDataFrame([], "step string, blocks long"))
    blocks = cut(balls(vectors, middle, rows))
    parts = max(1, -(-refs.count() // BATCH))
    t = angles(refs, middle, False).select(F.col("doc_id").alias("reference_id"), "c", "angle")
    least = F.greatest(F.lit(0.0), F.col("lo") - F.col("angle"), F.col("angle") - F.col("hi"))
    bounds = t.join(blocks.select("c", "shell", "lo", "hi", "size"), "c").select("reference_id", "c", "shell", "size", F.cos(least).alias("most"))
    order = Window.partitionBy("reference_id").orderBy(F.col("most").desc(), "c", "shell").rowsBetween(Window.unboundedPreceding, -1)
    bounds = cut(bounds.withColumn("early", F.coalesce(F.sum("size").over(order), F.lit(0)) < max(n, rows)))
    first = cut(met(bounds.where("early").select("reference_id", "c", "shell"), refs, blocks, n, parts))
    floor = best(first, n).groupBy("reference_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")
    bounds = cut(bounds.join(floor, "reference_id", "left").withColumn("later", ~F.col("early") & (F.col("most") >= F.coalesce("floor", F.lit(-1.0)) - SLACK)))
    more = met(bounds.where("later").select("reference_id", "c", "shell"), refs, blocks, n, parts)
    count = lambda c, s: bounds.where(c).agg(F.lit(s).alias("step"), F.count(F.lit(1)).alias("blocks"))
    return BallTop(best(first.unionByName(more), n), count("true", "all").unionByName(count("early", "first")).unionByName(count("later", "later")))
