"""Exact best n partners of each reference without joining all postings of the terms they share.

Partners fall into classes by their number of terms and their largest weight, so a class has weights of one order. For each reference and class, a term adds at
most reference weight x the class's largest weight of the term. Then:

1. each reference meets its strongest terms and classes, as far as they hold `first` x n postings; the best partners found are scored in
   full, which gives a floor of the n-th best score;
2. in each class the terms with most postings for what they can add stay out, as long as they add at most half the floor together (a
   class whose terms all together stay below the floor stays out whole). The others are joined; whoever can be among the best is seen now;
3. of the partners seen, those who reach the floor with what their class has left out are completed from just these terms.

All is exact: bounds are compared with a slack far above rounding, and no posting of the join is met twice after the floor is known.
Groups of partners have floors of their own.

Distribution: joins by term and class, partial sums combined before the shuffle; the frequent terms, which make a join by term hot,
are those left out. The plan is a row for each reference, group, class and term; its windows run over one reference's terms. Floors
keep n rows of a reference before the shuffle.

Defined results: a null id or term joins nothing; weights must not be negative; references without a shared term have no partners; ties
go by id; equal (doc, term) rows add up; an empty side gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.scoring import PLACES
from matchloom.sources.scratch import cut

FIRST = 48
SLACK = 1e-9
#: Share of the floor that terms left out may add.
OUT = 0.97
ROUNDS = 3
PAIR = ["reference_id", "grp", "paired_id"]


@dataclass(frozen=True)
class PrunedTop:
    """scores: (reference_id, paired_id, score). work: (step, postings) joined: `all` that share a term, and those met in each step."""

    scores: DataFrame
    work: DataFrame


def classed(pairs: DataFrame, refs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(term, cls, grp, paired_id, pw) of the terms that references have; cls: six classes for each doubling of the number of
    terms, four for each of the largest weight."""
    own = pairs.where("doc_id IS NOT NULL").groupBy("doc_id", "term").agg(F.sum("weight").alias("pw"))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    own = own.select(F.col("doc_id").alias("paired_id"), "term", "pw", (F.floor(6 * F.log2(size)) * 64 + F.floor(-4 * F.log2(F.max("pw").over(Window.partitionBy("doc_id"))))).cast("int").alias("cls")).where("pw > 0")
    own = own.join(refs.select("term").distinct(), "term", "left_semi")
    return own.withColumn("grp", F.lit(0)) if groups is None else own.join(groups.select("paired_id", "grp"), "paired_id")


def partial(plan: DataFrame, postings: DataFrame) -> DataFrame:
    """Partial scores (reference_id, grp, paired_id, cls, score) from the planned terms."""
    met = postings.join(plan.select("reference_id", "grp", "term", "cls", "rw"), ["term", "cls", "grp"])
    return met.groupBy(*PAIR, "cls").agg(F.sum(F.col("rw") * F.col("pw")).alias("score"))


def looked_up(pairs: DataFrame, plan: DataFrame, postings: DataFrame) -> DataFrame:
    """(reference_id, grp, paired_id, more, _met): what the planned terms add to the given pairs, and the postings met for it."""
    asked = pairs.select(*PAIR, "cls").join(plan.select("reference_id", "grp", "cls", "term", "rw"), ["reference_id", "grp", "cls"])
    found = asked.join(postings.select("paired_id", "grp", "term", "pw"), ["paired_id", "grp", "term"])
    return found.groupBy(*PAIR).agg(F.sum(F.col("rw") * F.col("pw")).alias("more"), F.count(F.lit(1)).alias("_met"))


def best(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("reference_id", "grp").orderBy(F.round("score", PLACES).desc(), "paired_id")
    return scores.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def floors(scores: DataFrame, n: int) -> DataFrame:
    """(reference_id, grp, floor): the n-th best score where there are n."""
    return best(scores, n).groupBy("reference_id", "grp").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")


def pruned_top(refs: DataFrame, pairs: DataFrame, n: int, groups: DataFrame | None = None, first: int = FIRST, out: float = OUT) -> PrunedTop:
    """The n best partners of each reference, of each group (paired_id, grp) if given; refs and pairs: (doc_id, term, weight)."""
    if not refs.select("weight").unionAll(pairs.select("weight")).where("weight < 0").limit(1).isEmpty():
        raise ValueError("weights must not be negative")
    near = ["reference_id", "grp"]
    r = refs.where("weight > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("reference_id"), "term").agg(F.sum("weight").alias("rw"))
    postings = cut(classed(pairs, r, groups))
    tops = postings.groupBy("term", "cls", "grp").agg(F.count(F.lit(1)).alias("size"), F.max("pw").alias("top"))
    plan = cut(r.join(tops, "term").withColumn("most", F.col("rw") * F.col("top")))

    strongest = Window.partitionBy(*near).orderBy(F.col("most").desc(), "term", "cls").rowsBetween(Window.unboundedPreceding, -1)
    early = cut(plan.withColumn("_before", F.coalesce(F.sum("size").over(strongest), F.lit(0))).where(F.col("_before") < first * n))
    tried = looked_up(best(partial(early, postings), 4 * n), plan, postings)
    tried = cut(tried.withColumnRenamed("more", "score"))
    known = floors(tried, n)

    rows = plan.join(known, near, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    cheap = Window.partitionBy(*near, "cls").orderBy((F.col("size") / F.col("most")).desc(), "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("most").over(Window.partitionBy(*near, "cls"))
    rows = cut(rows.withColumns({"_upto": F.sum("most").over(cheap) / F.col("floor"), "_skip": whole < F.col("floor")}).withColumn("_out", (F.col("floor") > 0) & (F.col("_upto") <= out)))
    seen = cut(partial(rows.where("NOT _out AND NOT _skip"), postings))
    work = [(plan, "size", "all"), (early, "size", "strongest terms"), (tried, "_met", "floor"), (rows.where("NOT _out AND NOT _skip"), "size", "terms joined")]
    exact = tried.select(*PAIR, "score")
    for k in range(ROUNDS + 1):
        share = out / 2**k
        left = rows.where("_out AND NOT _skip").where(F.col("_upto") <= share).groupBy(*near, "cls").agg(F.sum("most").alias("left"))
        floor = floors(seen.select(*PAIR, "score").unionByName(exact).groupBy(*PAIR).agg(F.max("score").alias("score")), n)
        may = seen.join(left, [*near, "cls"], "left").join(floor, near, "left").where(F.col("score") + F.coalesce("left", F.lit(0.0)) >= F.coalesce("floor", F.lit(0.0)) - SLACK)
        seen = may.select(*PAIR, "cls", "score")
        least = share / 2 if k < ROUNDS else 0.0
        seen = cut(seen)
        more = cut(looked_up(seen, rows.where("_out AND NOT _skip").where((F.col("_upto") <= share) & (F.col("_upto") > least)), postings))
        work.append((more, "_met", f"completed {k + 1}"))
        seen = seen.join(more, PAIR, "left").select(*PAIR, "cls", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    full = cut(seen)
    scores = best(full, n).select("reference_id", "paired_id", "score")
    counts = [df.agg(F.lit(name).alias("step"), F.coalesce(F.sum(c), F.lit(0)).alias("postings")) for df, c, name in work]
    return PrunedTop(scores, reduce(DataFrame.unionByName, counts))
