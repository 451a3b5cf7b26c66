"""Joins of score tables and membership joins."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.ranking import numbered_rows
from matchloom.operators.scoring import BROADCAST_ROWS
from matchloom.sources.files import read_data_if_needed


def selected(data: DataFrame, cols: dict[str, str] | Sequence[str] | None) -> DataFrame:
    """Named columns; a dict renames (new name: old name)."""
    if cols is None:
        return data
    return data.select(*[F.col(old).alias(new) for new, old in (cols.items() if isinstance(cols, dict) else ((c, c) for c in cols))])


def natural_join(a: DataFrame, b: DataFrame, how: str = "left", on: Sequence[str] | None = None) -> DataFrame:
    """Join on all common columns (or `on`), null keys matching null keys; keys come once and first as in `a`."""
    keys = list(on) if on else [c for c in a.columns if c in b.columns]
    right = b.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(b.columns)])
    at = {c: f"_r{i}" for i, c in enumerate(b.columns)}
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[at[k]]) for k in keys])
    joined = a.join(right, cond, how)
    out = [F.coalesce(a[c], right[at[c]]).alias(c) if c in keys and how != "left" else a[c] for c in a.columns]
    return joined.select(*out, *[right[at[c]].alias(c) for c in b.columns if c not in keys])


def load_join_data(x, y, y_cols=None, x_cols=None, join_type: str = "left", spark: SparkSession | None = None, on: Sequence[str] | None = None) -> DataFrame:
    """One step: frames or paths, selected and renamed, joined on their common columns."""
    a, b = (read_data_if_needed(d, spark) for d in (x, y))
    return natural_join(selected(a, x_cols), selected(b, y_cols), "full" if join_type == "full" else "left", on)


def reduce_join(start, join_data: list, data_cols: list | None = None, join_type: str = "left", spark: SparkSession | None = None, on: Sequence[str] | None = None) -> DataFrame:
    """Fold of joins from `start` over `join_data`; `data_cols` needs an entry for each input or is not used."""
    if data_cols and len(data_cols) != len(join_data) + 1:
        warnings.warn("data_cols has not as many entries as there are inputs and is not used", stacklevel=2)
        data_cols = None
    first = selected(read_data_if_needed(start, spark), data_cols[0] if data_cols else None)
    steps = zip(join_data, data_cols[1:] if data_cols else [None] * len(join_data), strict=True)
    return reduce(lambda acc, step: load_join_data(acc, step[0], y_cols=step[1], join_type=join_type, spark=spark, on=on), steps, first)


def merge_scores(scores: dict[str, DataFrame], keys: Sequence[str] = ("reference_id", "paired_id"), score: str = "score") -> DataFrame:
    """Full join of any number of score tables on their ids in one shuffle; each score column gets its key: score_<key>.

    The tables are stacked with their numbers and aggregated by id into one list for each table; the lists are then laid out beside each
    other, so repeated ids pair up as in a join. Rows with a null id match nothing and stay as they are. An id's lists are one row.
    """
    cols = {k: f"{score}_{k}" for k in scores}
    stacked = union_by_name(*[df.select(*keys, F.struct(F.col(score).alias("s")).alias(cols[k])) for k, df in scores.items()])
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    out = stacked.where(known).groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in cols.values()])
    for c in cols.values():
        out = out.withColumn(c, F.explode_outer(c))
    return out.unionByName(stacked.where(~known)).select(*keys, *[F.col(f"{c}.s").alias(c) for c in cols.values()])


def merge_score_results(a: DataFrame, b: DataFrame, how: str = "inner", score_cols: Sequence[str] = ("score",)) -> DataFrame:
    """Merge on all common columns but the scores, whose names get _x and _y; any kind of join."""
    keys = [c for c in a.columns if c in b.columns and c not in score_cols]
    left = a.withColumnsRenamed({c: f"{c}_x" for c in score_cols if c in b.columns})
    right = b.withColumnsRenamed({c: f"{c}_y" for c in score_cols if c in a.columns})
    return left.join(right, keys, {"outer": "full"}.get(how, how))


def join_different(a: DataFrame, b: DataFrame, keys: dict[str, str], how: str = "left") -> DataFrame:
    """Join on keys of different names (left name: right name)."""
    return a.join(b, reduce(lambda x, y: x & y, [a[k] == b[v] for k, v in keys.items()]), how)


def keep_known(data: DataFrame, col: str, known: DataFrame, known_col: str | None = None) -> DataFrame:
    """Rows whose value stands in another table."""
    other = known.select(F.col(known_col or col).alias("_known")).distinct()
    return data.join(other, data[col] == other["_known"], "left_semi")


def keep_known_in_group(data: DataFrame, group: str, col: str, known: DataFrame, known_col: str) -> DataFrame:
    """Rows whose value stands in another table under the same group."""
    other = known.select(F.col(group).alias("_group"), F.col(known_col).alias("_known")).distinct()
    return data.join(other, (data[group] == other["_group"]) & (data[col] == other["_known"]), "left_semi")


def with_reverse(scores: DataFrame, a: str = "reference_id", b: str = "paired_id", score: str = "score") -> DataFrame:
    """Adds the score of the swapped pair, null without one: a check of symmetry."""
    other = scores.select(F.col(a).alias("_b"), F.col(b).alias("_a"), F.col(score).alias(f"{score}_reverse"))
    return scores.join(other, (scores[a] == other["_a"]) & (scores[b] == other["_b"]), "left").drop("_a", "_b")


def scores_with_reverse(refs: DataFrame, pairs: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], both: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """`with_reverse` of the scores of references with partners (doc_id, ...). Only partners that are references can have a swapped
    pair, so the other pairs are not looked up. `both`: gives scores and those of the swapped pairs at once, so none are joined."""
    known = refs.select("doc_id").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    alone, other = score(refs, pairs.join(known, "doc_id", "left_anti")), pairs.join(known, "doc_id", "left_semi")
    met = with_reverse(score(refs, other)) if both is None else both(refs, other)
    return met.unionByName(alone.withColumn("score_reverse", F.lit(None).cast(dict(alone.dtypes)["score"])))


def exploded_pairs(data: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of two list columns that belong together element by element."""
    return data.withColumn("_z", F.explode(F.arrays_zip(a, b))).withColumns({a: F.col(f"_z.{a}"), b: F.col(f"_z.{b}")}).drop("_z")


def bind_columns(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Columns of `a` beside those of `b`, row by row in the order of a numeric key of each side; a shorter side ends in nulls.
    `b` may repeat no column name of `a`."""
    x, y = numbered_rows(a, order_a, "_row"), numbered_rows(b, order_b, "_row")
    return x.join(y, "_row", "full").drop("_row")


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
