"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else the one named in spark.checkpoint.dir. Only a session whose executors run in
    this process, as in tests, gets a temporary folder; on a cluster it is an error to have set none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder until nothing refers to it any more."""
    context = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # else the files stay for good
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
