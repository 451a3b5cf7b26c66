"""Pair predicates. Each is called with two functions that give a column of the reference's and of the paired side, and
returns a condition over a scored pair (columns reference_id, paired_id, score)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Side = Callable[[str], Column]
Predicate = Callable[[Side, Side], Column]


def default_pairable(ref: Side, pair: Side) -> Column:
    """A positive score, and not the reference itself."""
    return (F.col("score") > 0) & (F.col("paired_id") != F.col("reference_id"))


def always(ref: Side, pair: Side) -> Column:
    """Keeps self pairs and zeros."""
    return F.lit(True)


def vals_differ_in_col(col: str) -> Predicate:
    return lambda ref, pair: ref(col) != pair(col)


def vals_differ_in_all_cols(cols: list[str]) -> Predicate:
    return lambda ref, pair: reduce(lambda a, b: a & b, [ref(c) != pair(c) for c in cols])


def pairable_by_group(group_col: str) -> Predicate:
    """The default, for pairs of different groups."""
    return both(default_pairable, vals_differ_in_col(group_col))


def both(*predicates: Predicate) -> Predicate:
    return lambda ref, pair: reduce(lambda a, b: a & b, [p(ref, pair) for p in predicates])
