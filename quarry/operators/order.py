"""Positions of rows in a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.scratch import scratch


def numbered(rows: DataFrame, order: list[str], name: str = "n", start: int = 0) -> DataFrame:
    """rows with their position (from `start`) in the order of some columns, which should tell rows apart: rows
    that are equal in them get positions of their own, in no stated order.

    Range partitions are sorted and written, so that a task that runs again finds the same ranges; the driver
    gets one count for each partition, and a row's position is the sum of the counts before it and its place inside.
    """
    part = f"{name}_part"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return offset(dealt.select("*", F.spark_partition_id().alias(part)), part, name, start)


def offset(rows: DataFrame, part: str, name: str, start: int = 0) -> DataFrame:
    """rows without part and with their number: parts follow one another in the order of their keys, and the rows of a
    part as they come, which must be one after the other in one task.

    The rows are written first, with their places, so that both the counts and the result see the same.
    """
    spark, place = rows.sparkSession, f"{name}_place"
    path = scratch(spark, "numbered")
    placed = rows.withColumn(place, F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    # A row for each partition of the input.
    counts = sorted((r[0], r["first"], r["n"]) for r in placed.groupBy(part).agg(F.min(place).alias("first"), F.count("*").alias("n")).collect())
    before, total = [], start
    for key, first, n in counts:
        before.append((key, total - first))
        total += n
    kind = placed.schema[part].dataType.simpleString()
    table = spark.createDataFrame(before, f"`{part}` {kind}, _before bigint")
    number = (F.col("_before") + F.col(place)).alias(name)
    return placed.join(F.broadcast(table), part).select(*(F.col(f"`{c}`") for c in rows.columns if c != part), number)
