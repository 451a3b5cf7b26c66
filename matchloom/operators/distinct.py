"""Exact distinct counts that add up over levels: bitmaps of numbered values.

Values are numbered once; a group's values are bits of bitmaps of fixed size, one for each bucket of numbers that occurs. Bitmaps of
one level are made into those of any coarser level by OR, so counts by several keys and over all come from one table, where distinct
counts of each level would each shuffle all values again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scan import null_safe, scanned


def bitmaps(data: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., bucket, bits) of the values in each group; null is a value like any other."""
    numbers = scanned(data.select(F.col(value).alias("_value")).distinct(), [F.col("_value").asc_nulls_first()], place="_number")
    own = data.join(numbers, null_safe(data, numbers, {value: "_value"}))
    return own.groupBy(*by, F.bitmap_bucket_number("_number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bits"))


def rolled_up(maps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bitmaps of a coarser level."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(maps: DataFrame, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """(by..., n): distinct values at a level of the bitmaps or a coarser one."""
    return rolled_up(maps, by).groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))
