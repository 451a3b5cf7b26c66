"""Places and running sums in one order over all rows, or in each group, without a task that sorts a whole group.

Rows are sorted by ranges, so each task holds a stretch of the order, and kept in the shared folder: a row's place is its place in
the task's stretch plus the rows of the group in the stretches before. Those offsets come from a table of one row for each stretch and
group. A group with all rows is spread over as many tasks as there are ranges; rows equal in the whole order are spread too, so `order`
should tell apart what is to be numbered apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.scratch import cut


def null_safe(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[v]) for k, v in keys.items()])


def scanned(data: DataFrame, order: Sequence[Column], by: Sequence[str] = (), place: str = "place", value: str | None = None, running: str = "running", size: str | None = None) -> DataFrame:
    """Adds `place` (1..n in the order, within `by`); with `value` also its running sum, this row included; with `size` the
    rows of the group. Null groups are a group."""
    own = [F.col(c) for c in by]
    stretches = data.repartitionByRange(*own, *order, F.rand(1)).sortWithinPartitions(*own, *order)
    rows = cut(stretches.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sums = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")] + ([F.sum(value).alias("_s")] if value else [])
    parts = rows.groupBy(*by, "_part").agg(*sums)
    if by:
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        kinds = {"_rows": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(*by))}
        if value:
            kinds["_sum"] = F.coalesce(F.sum("_s").over(before), F.lit(0))
        parts = parts.withColumns(kinds)
    else:
        parts = summed_up(parts, value)
    names = {f"_scan{i}": c for i, c in enumerate(by)}
    parts = parts.select(*[F.col(c).alias(g) for g, c in names.items()], F.col("_part").alias("_p"), *[c for c in parts.columns if c not in by and c != "_part"])
    if value:
        rows = rows.withColumn("_local", F.sum(value).over(Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.join(parts, null_safe(rows, parts, {c: g for g, c in names.items()} | {"_part": "_p"}))
    new = [(F.col("_rows") + F.col("_at") - F.col("_first") + 1).alias(place)]
    new += [(F.col("_sum") + F.coalesce("_local", F.lit(0))).alias(running)] if value else []
    return out.select(*data.columns, *new, *([F.col("_size").alias(size)] if size else []))


def summed_up(parts: DataFrame, value: str | None) -> DataFrame:
    """Offsets over one row for each range of the sort: so few are summed on the driver."""
    rows = sorted(parts.collect(), key=lambda r: r["_part"])
    total, at, s, out = sum(r["_n"] for r in rows), 0, 0, []
    for r in rows:
        out.append((*r, at, total, *([s] if value else [])))
        at += r["_n"]
        s += (r["_s"] or 0) if value else 0
    kind = dict(parts.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in parts.columns) + ", _rows long, _size long" + (f", _sum {kind['_s']}" if value else "")
    return parts.sparkSession.createDataFrame(out, schema)
