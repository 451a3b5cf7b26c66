"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.scratch import cut, delete, shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process, as in tests."""
    return shared_folder(spark)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most `rows` rows, unless the session asks for fewer: rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for larger tables of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table of `written` once everything derived from it is written itself."""
    delete(table.sparkSession, table.written_to)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """`df` with its columns renamed by position, so that no name of it clashes with names used inside an operator, and
    the new names of the columns `names`."""
    new = [f"column_{i}" for i in range(len(df.columns))]
    return df.toDF(*new), [new[df.columns.index(n)] for n in names]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle and checkpoint files of steps that nothing refers to; it follows the driver's garbage collection."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # the cleaner works beside


__all__ = ["Steps", "cut", "drop", "numbered", "release", "shared_dir", "small_batches", "written"]


class Steps:
    """The tables of one run of an operator, deleted together when its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(written(df))
        return self.tables[-1]

    def done(self, result: DataFrame) -> DataFrame:
        out = written(result)
        for table in self.tables:
            drop(table)
        return out
