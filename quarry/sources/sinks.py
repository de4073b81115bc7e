"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.sources import markdown_files, versions


def jsonl(rows: DataFrame, path: str, order: list | None = None, single: bool = True) -> None:
    """One JSON object per line, nulls kept. single: one ordered file, for small tables; else a file per partition."""
    rows = rows.orderBy(*order) if order else rows
    rows = rows.coalesce(1) if single else rows
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def index(chunks: DataFrame, path: str) -> None:
    """Replace an index table, or make it. Ids must be unique, and equal names of different documents show up as equal ids.

    The new table is written whole and checked in a folder of its own, and becomes the current version by one small file. A run
    that fails anywhere leaves the version before, and a reader always finds one of the two.
    """
    spark = chunks.sparkSession
    store = versions.Store(spark, path)
    found = versions.current(store)
    name = versions.fresh(store, "table")
    chunks.write.parquet(f"{store.top}/{name}")
    twice = spark.read.parquet(f"{store.top}/{name}").groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        store.delete(name)
        raise ValueError(f"ids that occur twice: {[r['id'] for r in twice]}")
    versions.commit(store, {"folders": [name], "table": name}, found and found[0])


def markdown(rows: DataFrame, folder: str) -> None:
    """An .md file in a folder for each converted document (file_name, text), named as its source; one that failed has none.

    Each task writes its own files (see markdown_files); what an executor reads by its own file systems is a local path, or one of
    the schemes that Arrow knows.
    """
    spark = rows.sparkSession
    spark.dataSource.register(markdown_files.MarkdownFiles)
    stem = F.regexp_replace("file_name", r"\.[^.]*\z", "")
    good = rows.where(F.col("text").isNotNull()).select(stem.alias("name"), "text")
    good.write.format("markdown_files").option("path", folder).mode("append").save()


def append_missing(rows: DataFrame, path: str, key: str) -> None:
    """Write rows whose key the output doesn't have yet: a run that broke off goes on where it stopped.

    Give the rows before an expensive step, such as generation, to `unfinished` to skip it for what is done.
    """
    unfinished(rows, path, key).write.mode("append").parquet(path)


def unfinished(rows: DataFrame, path: str, key: str) -> DataFrame:
    try:
        done = rows.sparkSession.read.parquet(path).select(key).distinct()
    except AnalysisException:
        return rows
    return rows.join(done, key, "left_anti")
