"""Incremental chunking and indexing: documents that arrive as files are chunked once and appended to a table, or to an index as segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Settings
from quarry.functions.chunking import chunks
from quarry.operators import ask, vectors
from quarry.operators.order import numbered


def chunk_new_files(
    spark: SparkSession,
    source: str,
    schema: str,
    name: Column,
    text: Column,
    target: str,
    checkpoint: str,
    separator: str = "\n\n",
    settings: Settings = DEFAULT,
) -> None:
    """Read the Parquet files that no earlier call has read, append their chunks to target, and return when done.

    The file sink commits a batch as a whole, so a call that is repeated after a failure adds each chunk once.
    """
    docs: DataFrame = spark.readStream.schema(schema).parquet(source)
    query = (
        chunks(docs, name, text, separator, settings)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def index_new_files(
    spark: SparkSession,
    source: str,
    schema: str,
    name: Column,
    text: Column,
    path: str,
    checkpoint: str,
    separator: str = "\n\n",
    settings: Settings = DEFAULT,
    embedder: vectors.Embedder | None = None,
    files: int = 1000,
) -> None:
    """Chunk the Parquet files that no earlier call has read, and add them to the index at a path, a segment for each micro-batch.

    Ids hold a hash of name and text, so a micro-batch that is run again after a failure adds only the chunks that the
    index doesn't have, and documents that come again add none. Corpus order is the order of arrival, by id inside a micro-batch. `ask.merge` joins segments.
    """

    def add(batch: DataFrame, number: int) -> None:
        held = chunks(batch, name, text, separator, settings).select("id", F.col("doc_name").alias("pdf_name"), "text").dropDuplicates(["id"])
        add_chunks(held, path, settings, embedder)

    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .parquet(source)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def add_chunks(held: DataFrame, path: str, settings: Settings = DEFAULT, embedder: vectors.Embedder | None = None) -> None:
    """Add the chunks (id, pdf_name, text) that the index at a path doesn't have, after those that it has; make the index if there is none."""
    spark = held.sparkSession
    try:
        index = ask.opened(spark, path)
    except FileNotFoundError:
        ask.build(numbered(held, ["id"], "ord"), path, embedder, settings)
        return
    fresh = numbered(held.join(index.chunks().select("id"), "id", "left_anti"), ["id"], "ord", start=index.n_docs)
    if not fresh.isEmpty():
        ask.append(fresh, path, embedder, settings)
