"""Statistics as column expressions: parsed summaries, distances, combined scores, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS = ("min", "max", "median", "sd")
#: Scores are rounded to so many places before they are compared, so that ties do not depend on the order of summation.
PLACES = 10


def stat_value(text: Column, name: str) -> Column:
    """Number after `name=` in a '; '-delimited list; null if absent or not numeric."""
    return F.regexp_extract(text, rf"(?:^|;\s*){name}\s*=\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*(?:;|$)", 1).try_cast("double")


def parsed_stats(text: Column) -> Column:
    """struct(min, max, median, sd, range) of a summary text; null if fewer than three of the four are there."""
    values = {s: stat_value(text, s) for s in STATS}
    known = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values.values()])
    fields = [v.alias(s) for s, v in values.items()] + [(values["max"] - values["min"]).alias("range")]
    return F.when(known >= 3, F.struct(*fields))


def _fields(a: Column, b: Column) -> list[tuple[Column, Column]]:
    return [(a[s], b[s]) for s in (*STATS, "range")]


def euclidean_distance(a: Column, b: Column) -> Column:
    """Distance over the five statistics, scaled up for missing ones; null if a side or all statistics are missing."""
    pairs = _fields(a, b)
    used = reduce(lambda x, y: x + y, [(p - q).isNotNull().cast("int") for p, q in pairs])
    total = reduce(lambda x, y: x + y, [F.coalesce(F.pow(p - q, 2), F.lit(0.0)) for p, q in pairs])
    return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(F.try_divide(total * len(pairs), used.cast("double"))))


def relative_distance(a: Column, b: Column) -> Column:
    """One minus the mean relative difference of the known statistics, each at most 1; equal values differ by 0."""
    parts = [F.when(p == q, 0.0).otherwise(F.when((p - q).isNotNull(), F.least(F.lit(1.0), F.abs(p - q) / F.greatest(F.abs(p), F.abs(q))))) for p, q in _fields(a, b)]
    used = reduce(lambda x, y: x + y, [p.isNotNull().cast("int") for p in parts])
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(a.isNotNull() & b.isNotNull(), 1 - F.try_divide(total, used.cast("double")))


def overall_similarity(*scores: Column, variant: str = "coded") -> Column:
    """Squared noisy-or of two to four scores. With four, `coded` reads the exponent from scores 1, 2, 3, 3 and
    `documented` from 2, 3, 4."""
    first, rest = scores[0], list(scores[1:])
    if not 1 <= len(rest) <= 3:
        raise ValueError("two to four scores are combined")
    if len(rest) == 3 and variant == "coded":
        powers = [F.pow(first, 2), F.pow(rest[0], 3), F.pow(rest[1], 3)]
    elif len(rest) == 3:
        powers = [F.pow(rest[0], 2), F.pow(rest[1], 3), F.pow(rest[2], 3)]
    else:
        powers = [F.pow(s, i + 2) for i, s in enumerate(rest)]
    return 1 - F.pow(1 - first, reduce(lambda a, b: a + b, powers, F.lit(1.0)))


def zero_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where that is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(true_predicted: Column, predicted: Column) -> Column:
    return zero_ratio(true_predicted, predicted)


def recall(true_predicted: Column, actual: Column) -> Column:
    return zero_ratio(true_predicted, actual)


def f1(true_predicted: Column, predicted: Column, actual: Column) -> Column:
    p, r = precision(true_predicted, predicted), recall(true_predicted, actual)
    return zero_ratio(2 * p * r, p + r)


def n_unique(x: Column) -> Column:
    """Distinct values in an aggregation, null counting as one."""
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def n_pairings(x: Column, y: Column | None = None) -> Column:
    return n_unique(x) * (n_unique(x if y is None else y) - 1)


def strict_greatest(*cols: Column) -> Column:
    """Row maximum, null if any value is."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), F.greatest(*cols))


def strict_least(*cols: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), F.least(*cols))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
