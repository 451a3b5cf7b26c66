"""Logical lines of CSV files whose quoted fields hold line breaks, read by splits.

A line break ends a record where the quotes before it are even in number. A split of a file does not know how many there were before
it, so a first pass counts the quotes of each split and notes where its last record begins, for either parity; prefix sums over the
splits of a file, a row for each, tell every split its state. The second pass reads the splits side by side: lines that are a
record by themselves go on as they are, and only the lines of broken ones travel, to be joined in order.

A file is read in as many tasks as it has splits, whatever its fields hold. Doubled quotes do not change the parity; a lone quote
inside an unquoted field does, as it does for any reader of such files. A carriage return before a line break goes with it.
"""

from __future__ import annotations

import sys

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

PIECE = ["file string", "split long", "i long", "line string", "odd boolean", "opens boolean", "at0 long", "at1 long"]


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number in the split, whether the quotes before them are odd in number, whether their own are, and the line at
    which their record began if the split began outside (at0) or inside (at1) quotes; -1: before the split."""
    where, i, odd, last = None, 0, False, [-1, -1]
    for b in batches:
        file, split = b.column(1), b.column(2)
        names = np.asarray(file.dictionary_encode().indices) * 1.0
        new = np.flatnonzero((np.diff(names) != 0) | (np.diff(np.asarray(split)) != 0)) + 1
        quotes = np.asarray(pc.count_substring(b.column(0), '"')) % 2 == 1
        for lo, hi in zip([0, *new], [*new, b.num_rows], strict=True):
            if lo == hi:
                continue
            if (key := (file[lo].as_py(), split[lo].as_py())) != where:
                where, i, odd, last = key, 0, False, [-1, -1]
            own = quotes[lo:hi]
            before = np.concatenate([[odd], odd ^ (np.cumsum(own)[:-1] % 2 == 1)])
            at = np.arange(i, i + hi - lo)
            begins = []
            for k in (0, 1):
                start = np.maximum.accumulate(np.where(before == bool(k), at, -1))
                begins.append(np.where(start < 0, last[k], start))
                last[k] = int(begins[k][-1])
            i, odd = i + hi - lo, bool(before[-1] ^ own[-1])
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(at), part.column(0), pa.array(before), pa.array(own), *map(pa.array, begins)], names=[c.split()[0] for c in PIECE])


def states(pieces: DataFrame) -> DataFrame:
    """(file, split, inside, open_split, open_i): whether each split begins inside quotes, and where the record begins that is open there."""
    ends = pieces.groupBy("file", "split").agg(F.count_if("opens").alias("q"), F.max("at0").alias("at0"), F.max("at1").alias("at1"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.withColumn("inside", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("inside"), F.col("at1")).otherwise(F.col("at0"))
    begun = F.last(F.when(own >= 0, F.struct("split", own.alias("i"))), ignorenulls=True).over(before)
    return known.select("file", "split", "inside", begun.alias("open")).select("file", "split", "inside", F.col("open.split").alias("open_split"), F.col("open.i").alias("open_i"))


def logical_lines(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(line, first): the records of the files as text, and with `header` whether each is the first one of its file."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    pieces = raw.mapInArrow(running, ", ".join(PIECE))
    told = states(pieces).select(F.col("file").alias("f"), F.col("split").alias("s"), "inside", "open_split", "open_i")
    lines = pieces.join(told, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    inside = F.col("odd") != F.col("inside")
    begin = F.when(F.col("inside"), F.col("at1")).otherwise(F.col("at0"))
    lines = lines.select("file", "split", "i", "line", inside.alias("in"), (inside != F.col("opens")).alias("out"), F.when(begin < 0, F.col("open_split")).otherwise(F.col("split")).alias("b"), F.when(begin < 0, F.col("open_i")).otherwise(begin).alias("bi"))
    bare = lambda c: F.regexp_replace(c, "\r$", "")
    first = lambda split, i: (F.col(split) == 0) & (F.col(i) == 0) if header else F.lit(False)
    whole = lines.where("NOT in AND NOT out").select(bare(F.col("line")).alias("line"), first("split", "i").alias("first"))
    parts = lines.where("in OR out").groupBy("file", "b", "bi").agg(F.array_sort(F.collect_list(F.struct("split", "i", "line"))).alias("x"))
    joined = parts.select(bare(F.array_join(F.transform("x", lambda p: p["line"]), "\n")).alias("line"), first("b", "bi").alias("first"))
    return whole.unionByName(joined)
