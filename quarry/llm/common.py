"""Helpers that the training-data operators share: shared storage, folds, Arrow maps."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scratch import scratch

#: Bytes of text that an Arrow map looks at in one go; its arrays take some tens of times as much.
PIECE_BYTES = 1 << 18
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """The same table, in a session whose Arrow batches hold BATCH_BYTES at most, unless a size is set there.

    A batch is held whole by the executor and by its Python worker, and rows differ much in size.
    """
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    conf = df.sparkSession.conf
    if conf.get(name, default) == default:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    Nothing in it depends on one executor's memory or disk, so a later stage
    survives the loss of any of them. The table goes by dropped(), or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove a table made by written() that nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over: Spark removes them when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def fold(column, parts: int):
    """crc32 of a key as text, modulo parts: the folds of the held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def pieces(batches, column: str, limit: int = PIECE_BYTES):
    """Cut Arrow batches so that each piece holds about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = batch.column(at)
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes of a column as one array, and the offsets of the rows in it. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ddl(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
