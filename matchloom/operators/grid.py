"""Theta joins on a grid: every pair of rows in one cell of bounded area, cells that an inequality rules out left out.

Both sides are numbered in an order and cut into stretches of equal length; stretch i of one side and j of the other make a cell. Rows go
to the cells of their stretch, and the sides meet by cell number: an equality join with the condition on top, spread over as
many tasks as there are cells, without a cartesian product. For `less` the order is the compared column itself, so a cell whose
smallest left value is not below its largest right one holds no pair and is left out; equal values may lie in several stretches.

A row is sent once for each cell of its stretch. So that this stays some CELLS times as the input grows, stretches grow with it up to SIDE
rows, which is what a task holds of one side of a cell; its pairs pass through one by one. At most CUTS stretches a side are made, whose
ends the driver knows; beyond that the cells grow. Joins of many pairs get a task for some TASK pairs, whatever the rows weigh.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scan import scanned

AREA = 1 << 22
CUTS = 2048
CELLS, SIDE, TASK = 64, 1 << 14, 1 << 26


def side_of(n: int, m: int, area: int) -> int:
    """Rows of a stretch: the side of `area`, or more if a row were sent to more than some CELLS cells, up to SIDE."""
    return max(1, math.isqrt(area), min(SIDE, -(-max(n, m) // CELLS)))


def dealt_out(data: DataFrame, pairs: int, cells: int) -> DataFrame:
    """Rows by cell in enough tasks for that many pairs; few pairs are left to the session's number."""
    tasks = min(cells, pairs // TASK)
    return data.repartition(tasks, "_i", "_j") if tasks > int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")) else data


def stretched(data: DataFrame, key: str | None, n: int, side: int, name: str) -> DataFrame:
    row = F.xxhash64(*data.columns)
    order = [row] if key is None else [F.col(key), row]
    place = scanned(data, order, place=name)
    return place.withColumn(name, F.floor((F.col(name) - 1) / max(side, -(-n // CUTS))).cast("int"))


def ends(data: DataFrame, key: str, name: str, upper: bool) -> list:
    rows = data.groupBy(name).agg((F.max if upper else F.min)(key).alias("e")).collect()  # at most CUTS rows
    return [r["e"] for r in sorted(rows, key=lambda r: r[name])]


def grid_join(left: DataFrame, right: DataFrame, condition: Column | None = None, less: tuple[str, str] | None = None, area: int = AREA) -> DataFrame:
    """All pairs of rows for which `condition` holds and, with less=(a, b), left.a < right.b. The sides share no column names;
    rows whose compared value is null pair with nothing."""
    if common := set(left.columns) & set(right.columns):
        raise ValueError(f"columns on both sides: {sorted(common)}")
    if less:
        left, right = left.where(F.col(less[0]).isNotNull()), right.where(F.col(less[1]).isNotNull())
        condition = (F.col(less[0]) < F.col(less[1])) if condition is None else condition & (F.col(less[0]) < F.col(less[1]))
    n, m = left.count(), right.count()
    side = side_of(n, m, area)
    a, b = stretched(left, less and less[0], n, side, "_i"), stretched(right, less and less[1], m, side, "_j")
    rows, cols = (max(1, -(-x // max(side, -(-x // CUTS)))) for x in (n, m))
    if less:
        low, high = ends(a, less[0], "_i", False), ends(b, less[1], "_j", True)
        first = [bisect.bisect_right(high, x) for x in low]  # the first stretch of the right that holds a larger value
        last = [bisect.bisect_left(low, x) - 1 for x in high]
    else:
        first, last = [0] * rows, [rows - 1] * cols
    at = lambda values, i: F.get(F.array(*map(F.lit, values or [0])), F.col(i))
    a = a.withColumn("_first", at(first, "_i")).where(F.col("_first") < cols).withColumn("_j", F.explode(F.sequence(F.col("_first"), F.lit(cols - 1)))).drop("_first")
    b = b.withColumn("_last", at(last, "_j")).where("_last >= 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    met = dealt_out(a, n * m, rows * cols).join(dealt_out(b, n * m, rows * cols), ["_i", "_j"])
    return (met if condition is None else met.where(condition)).select(*left.columns, *right.columns)
