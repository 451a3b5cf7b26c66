"""Pairable pairs and ranks of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.scan import null_safe, scanned
from matchloom.operators.scoring import PLACES


def extract_pairable_pairs(data: DataFrame, ref: str, paired: str, ref_group: str | None = None, paired_group: str | None = None, class_col: str | None = None, classes_to_remove: list[str] = (), keep_single_ref_class: bool = False) -> DataFrame:
    """Pairs of different ids, of different groups if both group columns are given, of classes that are not removed and
    that still have two references after this (unless `keep_single_ref_class`)."""
    out = data.where(F.col(ref) != F.col(paired))
    if ref_group and paired_group:
        out = out.where(F.col(ref_group) != F.col(paired_group))
    if class_col:
        if classes_to_remove:
            out = out.where(~F.col(class_col).isin(list(classes_to_remove)))
        if not keep_single_ref_class:
            several = out.groupBy(F.col(class_col).alias("_c")).agg(F.min(ref).alias("_a"), F.max(ref).alias("_b")).where("_a <> _b")
            out = out.join(several.select("_c"), out[class_col].eqNullSafe(F.col("_c")), "left_semi")
    return out


def pairable_sides(refs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides of the pairs that `extract_pairable_pairs` keeps and `assign_true_pairing` flags, without forming them: references
    (cls, ref_id, ref_group, ...) with a partner of another id and group, of classes with two such references, and partners
    (pair_id, pair_group, ...) with `classes`, an array of struct(c) of the classes of which they are references."""
    ends = pairs.groupBy(F.col("pair_group").alias("_g")).agg(F.min("pair_id").alias("_low"), F.max("pair_id").alias("_high"))
    other = (F.col("ref_group") != F.col("_g")) & ((F.col("_low") != F.col("ref_id")) | (F.col("_high") != F.col("ref_id")))
    met = refs.join(F.broadcast(ends), other, "left_semi")
    several = met.groupBy(F.col("cls").alias("_c")).agg(F.min("ref_id").alias("_a"), F.max("ref_id").alias("_b")).where("_a <> _b").select("_c")
    kept = met.join(several, met["cls"].eqNullSafe(several["_c"]), "left_semi")
    classes = kept.groupBy(F.col("ref_id").alias("_r")).agg(F.collect_set(F.struct(F.col("cls").alias("c"))).alias("classes"))
    return kept, pairs.join(classes, pairs["pair_id"] == classes["_r"], "left").drop("_r")


def score_rank(score: Column, by: list[str]) -> Column:
    """Dense rank of a score, largest first, within `by`; null for a score of 0 or null. Zeros take up a rank, so
    negative scores come after them."""
    s = F.round(score, PLACES)
    w = Window.partitionBy(*by).orderBy(s.desc_nulls_last())
    return F.when(s != 0, F.dense_rank().over(w))


def spread_ranks(data: DataFrame, score_col: str, by: list[str], name: str) -> DataFrame:
    """The same ranks without a window over a group: the distinct scores are numbered by a range-sorted scan and joined back, so
    a group with any share of the rows is spread over many tasks."""
    s = F.round(F.col(score_col), PLACES)
    own = data.withColumn("_s", s)
    groups = {f"_g{i}": c for i, c in enumerate(by)}
    values = own.where("_s IS NOT NULL").select(*[F.col(c).alias(g) for g, c in groups.items()], F.col("_s").alias("_v")).distinct()
    places = scanned(values, [F.col("_v").desc()], list(groups), name)
    same = null_safe(own, places, {c: g for g, c in groups.items()}) & (own["_s"] == places["_v"])
    return own.join(places, same, "left").select(*data.columns, F.when(F.col("_s") != 0, F.col(name)).cast("int").alias(name))


def rank_scores(data: DataFrame, score_col: str, ref_col: str, rank_by: str | None = None, filter_ranks: bool = False, rank_cutoff: int = 10, spread: bool = False) -> DataFrame:
    """Adds <score>_rank per reference, or per reference and partner data set; `spread` where one reference may have very many rows."""
    by = [ref_col, *([rank_by] if rank_by else [])]
    name = f"{score_col}_rank"
    out = spread_ranks(data, score_col, by, name) if spread else data.withColumn(name, score_rank(F.col(score_col), by))
    return out.where(F.col(name) <= rank_cutoff) if filter_ranks else out


def calc_ranks_all_scores(data: DataFrame, score_cols: list[str], ref_col: str, rank_by: str | None = None, filter_ranks: bool = True, rank_cutoff: int = 10, spread: bool = False) -> DataFrame:
    """Ranks of several scores; rows stay if their best rank is within the cutoff. `spread`: see `rank_scores`."""
    by = [ref_col, *([rank_by] if rank_by else [])]
    if spread:
        out = data
        for s in score_cols:
            out = spread_ranks(out, s, by, f"{s}_rank")
    else:
        out = data.withColumns({f"{s}_rank": score_rank(F.col(s), by) for s in score_cols})
    if not filter_ranks:
        return out
    ranks = [F.col(f"{s}_rank") for s in score_cols]
    return out.where((F.least(*ranks) if len(ranks) > 1 else ranks[0]) <= rank_cutoff)


def row_numbers(data: DataFrame, by: list[str], order: list, name: str = "row_number") -> DataFrame:
    return data.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def numbered_rows(data: DataFrame, key: str, name: str = "row_number") -> DataFrame:
    """Rows with their place 1..n in the order of a key, nulls first, then of a hash of the row: a task that runs again gives the same
    places (only equal rows may change theirs), and rows of one key are spread over tasks like any others."""
    return scanned(data, [F.col(key).asc_nulls_first(), F.xxhash64(*data.columns)], place=name)


def top_with_ties(data: DataFrame, by: list[str], score: str, n: int = 10) -> DataFrame:
    """The n largest scores of each group, ties kept."""
    w = Window.partitionBy(*by).orderBy(F.round(score, PLACES).desc_nulls_last())
    return data.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= n).drop("_r")


def correct_match_max_rank(data: DataFrame, by: list[str], flag: str, rank: str, name: str = "max_rank") -> DataFrame:
    """Largest rank of a correct match in each group, on every row."""
    return data.withColumn(name, F.max(F.when(F.col(flag), F.col(rank))).over(Window.partitionBy(*by)))
