"""Profiles, tables for plots, reshaping, small cleaning steps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import pattern_renamed
from matchloom.operators.scan import scanned


def null_profile(data: DataFrame) -> DataFrame:
    """(column, nulls, rows) in one pass."""
    row = data.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(data.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(data.columns)])
    return row.select(F.explode(cells).alias("x"), "rows").select("x.column", "x.nulls", "rows")


def crosstab(data: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs, nulls kept as values."""
    return data.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


#: Rows around a quantile that are sorted together.
EXACT_ROWS = 1 << 16
ACCURACY = 8192


def narrowed(x: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """`brackets` (_b0..., share, n, k, lo, hi, below, inside) with bounds taken closer around the values numbered k and
    k + 1 by approximate quantiles of what lies inside; a bracket that would lose one of them stays as it was."""
    own = [*(f"_b{i}" for i in range(len(keys))), "share", "n", "k", "lo", "hi", "below", "inside"]
    within = [F.col(c).eqNullSafe(F.col(b)) for c, b in zip(keys, own, strict=False)] + [F.col("_x").between(F.col("lo"), F.col("hi"))]
    inside = x.join(brackets, within).select(*own, "_x")
    marks = inside.groupBy(*own).agg(F.percentile_approx("_x", [i / 2048 for i in range(2049)], ACCURACY).alias("m"))
    at = F.floor(2048 * (F.col("k") - F.col("below")) / F.col("inside"))
    bound = lambda i: F.get("m", F.least(F.greatest(i, F.lit(0)), F.lit(2048)).cast("int"))
    ends = marks.select(*own, F.when(at > 1, bound(at - 2)).otherwise(F.col("lo")).alias("a"), F.when(at < 2046, bound(at + 3)).otherwise(F.col("hi")).alias("b"))
    counts = x.join(ends, within).groupBy(*own, "a", "b").agg(F.count_if(F.col("_x") < F.col("a")).alias("less"), F.count_if(F.col("_x").between(F.col("a"), F.col("b"))).alias("c"))
    holds = (F.col("below") + F.col("less") <= F.col("k")) & (F.col("below") + F.col("less") + F.col("c") >= F.least(F.col("k") + 2, F.col("n")))
    new = {"lo": F.when(holds, F.col("a")).otherwise(F.col("lo")), "hi": F.when(holds, F.col("b")).otherwise(F.col("hi")), "below": F.when(holds, F.col("below") + F.col("less")).otherwise(F.col("below")), "inside": F.when(holds, F.col("c")).otherwise(F.col("inside"))}
    return counts.select(*own[: len(keys)], "share", "n", "k", *[c.alias(n) for n, c in new.items()])


def quantiles(data: DataFrame, col: str, shares: Sequence[float], by: Sequence[str] = (), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(by..., share, value): exact quantiles, interpolated between the two values around (n - 1) x share.

    Each is found in a bracket of values, the whole range at first. While brackets hold more than `exact_rows` rows,
    approximate quantiles narrow them some thousandfold a step; then the distinct values left are counted and put in order.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    x = data.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(col).cast("double").alias("_x")).where("_x IS NOT NULL")
    whole = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).where("n > 0")
    marks = [f"_b{i}" for i in range(len(by))]
    brackets = whole.toDF(*marks, "n", "lo", "hi").withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares)))))
    brackets = brackets.select(*marks, "share", "n", F.floor((F.col("n") - 1) * F.col("share")).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    for _ in range(8):
        if (brackets.where("lo < hi").agg(F.max("inside")).first()[0] or 0) <= exact_rows:
            break
        brackets = narrowed(x, brackets, keys)
    within = [F.col(c).eqNullSafe(F.col(b)) for c, b in zip(keys, marks, strict=True)] + [F.col("_x").between(F.col("lo"), F.col("hi"))]
    own = [*marks, "share", "n", "k", "below"]
    values = x.join(brackets, within).groupBy(*own, "_x").agg(F.count(F.lit(1)).alias("c"))
    upto = values.withColumn("_upto", F.col("below") + F.sum("c").over(Window.partitionBy(*own).orderBy("_x")))
    found = upto.groupBy(*own).agg(F.min(F.when(F.col("_upto") > F.col("k"), F.col("_x"))).alias("low"), F.min(F.when(F.col("_upto") > F.col("k") + 1, F.col("_x"))).alias("high"))
    value = F.col("low") + (F.coalesce("high", "low") - F.col("low")) * ((F.col("n") - 1) * F.col("share") - F.col("k"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, marks, strict=True)], "share", value.alias("value"))


def numeric_summary(data: DataFrame, col: str, by: Sequence[str] = (), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(by..., n, min, q25, q50, q75, mean, max)."""
    x, shares = F.col(col), (0.25, 0.5, 0.75)
    basic = data.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"))
    q = quantiles(data, col, shares, by, exact_rows).groupBy(*by).agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in shares])
    q = q.select(*[F.col(c).alias(f"_q_{c}") for c in by], "q25", "q50", "q75")
    joined = basic.join(q, [basic[c].eqNullSafe(q[f"_q_{c}"]) for c in by], "left") if by else basic.crossJoin(q)  # one row each
    return joined.select(*by, "n", "min", "q25", "q50", "q75", "mean", "max")


def grouped_max(data: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    return data.withColumn(name, F.max(col).over(Window.partitionBy(*by)))


def pair_type_counts(data: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    return data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def joined_values(col: str, sep: str = ": ") -> Column:
    """Distinct values of a group in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def spread(data: DataFrame, keys: Sequence[str], names: str, values: str, wanted: Sequence) -> DataFrame:
    """Wide form: one column for each wanted name."""
    return data.groupBy(*keys).pivot(names, list(wanted)).agg(F.first(values))


def gather(data: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "key", value: str = "value") -> DataFrame:
    return data.unpivot(list(keys), list(cols), name, value)


def quantile_bins(data: DataFrame, col: str, n: int = 10, name: str = "bin") -> DataFrame:
    """Bin 1..n by the column's exact quantiles; rows are not sorted."""
    found = quantiles(data, col, [i / n for i in range(1, n)])
    cuts = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "value"))), lambda c: c["value"]).alias("_cuts"))
    above = F.size(F.filter("_cuts", lambda c: F.col(col) > c)) + 1
    return data.crossJoin(cuts).withColumn(name, F.when(F.col(col).isNotNull(), above)).drop("_cuts")  # `cuts` is one row


def ecdf(data: DataFrame, value: Column) -> DataFrame:
    """(value, n, density): counts of each value and the share of rows up to it, by a scan over ranges of the distinct values."""
    return ecdf_of_counts(data.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")))


def ecdf_of_counts(counts: DataFrame) -> DataFrame:
    """The same from (value, n)."""
    upto = scanned(counts, [F.col("value")], place="_place", value="n", running="_upto")
    total = counts.agg(F.sum("n").alias("_all"))
    return upto.crossJoin(total).select("value", "n", (F.col("_upto") / F.col("_all")).alias("density"))  # `total` is one row


def tags(conditions: dict[str, Column], sep: str = "_") -> Column:
    """Names of the conditions that hold, joined."""
    return F.concat_ws(sep, *[F.when(c, F.lit(n)) for n, c in conditions.items()])


def value_map(col: Column, values: dict) -> Column:
    """Mapped values; others stay."""
    out = None
    for old, new in values.items():
        out = F.when(col == old, F.lit(new)) if out is None else out.when(col == old, F.lit(new))
    return out.otherwise(col.cast("string"))


def top_flags(rank: Column, cutoffs: Sequence[int]) -> dict[str, Column]:
    return {f"top{k}": F.coalesce(rank <= k, F.lit(False)) for k in cutoffs}


def rank_bucket(rank: Column) -> Column:
    return F.when(rank == 1, "1").when(rank <= 5, "2-5").when(rank <= 10, "6-10").when(rank > 10, ">10")


def matching_columns(data: DataFrame, pattern: str) -> list[str]:
    return [c for c in data.columns if re.search(pattern, c)]


def drop_matching(data: DataFrame, pattern: str) -> DataFrame:
    return data.drop(*matching_columns(data, pattern))


def head_and_tail(data: DataFrame, order: str, n: int) -> DataFrame:
    """The n first and the n last rows by a key."""
    return data.orderBy(order).limit(n).unionByName(data.orderBy(F.desc(order)).limit(n))


def sample_rows(data: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of the MD5 of "key:seed": the same rows on every run and in every engine."""
    return data.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def rename_matching(data: DataFrame, pattern: str, by: str) -> DataFrame:
    """Columns with every match of a pattern in their names replaced."""
    return data.toDF(*pattern_renamed(data.columns, pattern, by))


def numeric(col: str) -> Column:
    """Number in a text, null if it is none."""
    return F.col(col).try_cast("double")


def filled(data: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    return data.fillna(value, subset=list(cols))


def concept_filter(data: DataFrame, classes: Sequence[str], class_col: str = "concept_class_id", end_date: str = "valid_end_date", invalid: str = "invalid_reason") -> DataFrame:
    """Valid ontology concepts of the wanted classes."""
    return data.where(F.col(class_col).isin(list(classes)) & (F.col(end_date) == "20991231") & (F.coalesce(F.col(invalid), F.lit("")) == ""))
