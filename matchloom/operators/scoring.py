"""Scores of reference x candidate pairs, sparse and dense, with selectors and predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.predicates import Predicate, always, default_pairable
from matchloom.functions.stats import PLACES
from matchloom.operators.cells import dense_rows
from matchloom.operators.grid import grid_join
from matchloom.operators.termcells import sparse_rows

#: Largest counted number of reference rows whose terms are broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class TopN:
    """The n best candidates of each reference; ties by candidate id."""

    n: int

    def __call__(self, scores: DataFrame) -> DataFrame:
        w = Window.partitionBy("reference_id").orderBy(F.round("score", PLACES).desc(), "paired_id")
        return scores.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= self.n).drop("_place")


@dataclass(frozen=True)
class TopNByGroup:
    """The n best candidates of each reference in each candidate group (groups: paired_id, grp); candidates without a
    group are left out."""

    n: int
    groups: DataFrame = field(compare=False)

    def __call__(self, scores: DataFrame) -> DataFrame:
        w = Window.partitionBy("reference_id", "grp").orderBy(F.round("score", PLACES).desc(), "paired_id")
        joined = scores.join(self.groups.select("paired_id", "grp"), "paired_id")
        return joined.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= self.n).drop("_place", "grp").select(*scores.columns)


def all_scores(scores: DataFrame) -> DataFrame:
    return scores


def crossed(pairs: DataFrame, refs: DataFrame, few: bool = False) -> DataFrame:
    """Every candidate with every row of a stated reference set, which is broadcast if it is counted (or known) to be small and
    else meets the candidates on a grid; never a plain cartesian product."""
    if few or refs.count() <= BROADCAST_ROWS:
        return pairs.crossJoin(F.broadcast(refs))
    return grid_join(pairs, refs)


def sparse_scores(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(reference_id, paired_id, score) of pairs that share a term: a join by term over (doc_id, term, weight)."""
    r = refs.select(F.col("doc_id").alias("reference_id"), "term", F.col("weight").alias("rw"))
    p = pairs.select(F.col("doc_id").alias("paired_id"), "term", F.col("weight").alias("pw"))
    return p.join(r, "term").groupBy("reference_id", "paired_id").agg(F.sum(F.col("rw") * F.col("pw")).alias("score"))


def with_zeros(scores: DataFrame, ref_ids: DataFrame, pair_ids: DataFrame, counted: bool = False) -> DataFrame:
    """Scores of all pairs of a stated reference set with the candidates, 0 where they share nothing. `counted`: the
    references are known to be few already."""
    every = crossed(pair_ids.select("paired_id"), ref_ids.select("reference_id"), counted)
    return every.join(scores, ["reference_id", "paired_id"], "left").select("reference_id", "paired_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def dense_scores(refs: DataFrame, pairs: DataFrame, vec: str = "vec") -> DataFrame:
    """(reference_id, paired_id, score) of a stated reference set with all candidates: dot products of arrays, formed in cells."""
    return dense_rows(refs, pairs, vec)


def missing_ids(ids: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids without a document."""
    return ids.select(id_col).join(docs.select(id_col).distinct(), id_col, "left_anti")


class VariableSimilarityCalculator:
    """Scores references against candidates, selects, then filters.

    `ref_ids`: DataFrame (doc_id); unknown references drop out, repeated ones give repeated rows unless `distinct_refs`.
    `pairable`: predicate over a scored pair; `attributes`: DataFrame (doc_id, ...) that it may look at on either side.
    `select_scores`: applied before the predicate, so fewer than n pairs may remain of a top-n.
    `score_cols`: names of the three output columns.
    """

    def __init__(self, ref_ids: DataFrame, pairable: Predicate = default_pairable, select_scores=all_scores, score_cols: list[str] | None = None, attributes: DataFrame | None = None, distinct_refs: bool = False) -> None:
        self.ref_ids = ref_ids.select("doc_id").distinct() if distinct_refs else ref_ids.select("doc_id")
        self.pairable, self.select_scores, self.attributes = pairable, select_scores, attributes
        self.score_cols = score_cols or ["reference_id", "paired_id", "score"]

    def filter_scores(self, scores: DataFrame) -> DataFrame:
        if self.attributes is None:
            side = lambda name: F.col(name)
            return scores.where(self.pairable(side, side))
        extra = [c for c in self.attributes.columns if c != "doc_id"]
        for prefix, key in (("ref", "reference_id"), ("pair", "paired_id")):
            own = self.attributes.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"_{prefix}_{c}") for c in extra])
            scores = scores.join(own, key, "left")
        kept = scores.where(self.pairable(lambda c: F.col(f"_ref_{c}"), lambda c: F.col(f"_pair_{c}")))
        return kept.drop(*[f"_{p}_{c}" for p in ("ref", "pair") for c in extra])

    def score_variables(self, weights: DataFrame, pair_ids: DataFrame | None = None, strict: bool = False, zeros: bool | None = None, dense: bool = False, places: int | None = None, terms: DataFrame | None = None) -> DataFrame:
        """Scores over `weights` (doc_id, term, weight), or with `dense` over (doc_id, vec).

        Candidates default to all documents; `strict` raises if one of `pair_ids` is unknown. `zeros` keeps pairs that
        share nothing (default: only for the always-true predicate). `places`: sparse scores are rounded before they are selected.
        `terms`: (term) of the references, if they can be had without the weights.
        """
        if pair_ids is not None and strict and not (gone := missing_ids(pair_ids, weights)).isEmpty():
            raise ValueError(f"candidates without a document, e.g. {gone.first()['doc_id']}")
        few = self.ref_ids.count() <= BROADCAST_ROWS
        hint = F.broadcast if few else (lambda side: side)
        if dense:
            pairs = weights if pair_ids is None else weights.join(pair_ids.select("doc_id").distinct(), "doc_id", "left_semi")
            scores = dense_scores(weights.join(hint(self.ref_ids), "doc_id"), pairs)
        else:
            zeros = self.pairable is always if zeros is None else zeros
            best = self.select_scores.n if isinstance(self.select_scores, TopN) and not zeros else None
            scores = sparse_rows(weights, self.ref_ids, best, zeros, places, pair_ids=pair_ids, terms=terms)
            scores = scores.join(hint(self.ref_ids.withColumnRenamed("doc_id", "reference_id")), "reference_id")
        return self.filter_scores(self.select_scores(scores)).select("reference_id", "paired_id", "score").toDF(*self.score_cols)


def calculate_similarity(weights: DataFrame, doc_id) -> DataFrame:
    """(paired_id, score) of one document with all others, zeros included."""
    ref = weights.where(F.col("doc_id") == F.lit(doc_id))
    ids = weights.select(F.col("doc_id").alias("paired_id")).distinct()
    one = sparse_scores(ref, weights).select("paired_id", "score")
    return ids.join(one, "paired_id", "left").where(F.col("paired_id") != F.lit(doc_id)).select("paired_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_with_description(scores: DataFrame, descriptions: DataFrame, n: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Best n candidates of each reference joined with their descriptions."""
    return TopN(n)(scores).join(descriptions.withColumnRenamed(id_col, "paired_id"), "paired_id")


def matching(col_a: Column, col_b: Column) -> Column:
    return col_a.eqNullSafe(col_b)
