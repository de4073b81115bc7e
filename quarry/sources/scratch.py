"""The folder for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is named a local one serves, but only if all of Spark is one process: on a
    cluster every executor would write to its own disk.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return found or f"file://{tempfile.gettempdir()}/checkpoints"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the application's part of the shared folder, which is removed when the driver ends."""
    top = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(at):
        files.deleteOnExit(at)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


class Workspace:
    """The tables that one call writes and reads back; they go by clear() when its result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, rows: DataFrame, tag: str) -> DataFrame:
        self.paths.append(scratch(self.spark, tag))
        rows.write.parquet(self.paths[-1])
        return self.spark.read.schema(rows.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def result(rows: DataFrame, tag: str, work: Workspace) -> DataFrame:
    """A result of few rows, written, after which the tables that it came from go."""
    out = Workspace(rows.sparkSession).written(rows, tag)
    work.clear()
    return out
