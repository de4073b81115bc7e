"""Reproducible draws of passages, independent of partitions.

A draw is a number; hashes of seed and number take the place of a generator's state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Settings

#: Hex digits of a key's hash that name its bucket: 65,536 buckets.
BUCKET_DIGITS = 4
#: Hex digits that name a section of the ring, and the number of sections.
RING_DIGITS = 3
RING = 16**RING_DIGITS


def _key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def with_replacement(pool: DataFrame, id_col: str = "id", settings: Settings = DEFAULT) -> DataFrame:
    """draw, id: draw i takes the row whose place, in the order of hashed ids, is hash(i) modulo the number of rows.

    Places are found from counts of hash buckets, then by rank within the drawn buckets only, so
    no sort of the whole pool is needed.
    """
    spark = pool.sparkSession
    keyed = pool.select(F.col(id_col).alias("id"), _key(settings.seed, F.col(id_col)).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    ends = counts.withColumn("end", F.sum("n").over(Window.orderBy("bucket")))  # one row per bucket
    total = counts.agg(F.sum("n").alias("total"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{settings.seed}:"), F.col("draw").cast("string"))), 1, 12), 16, 10)
    draws = spark.range(settings.oracles).select(F.col("id").cast("int").alias("draw"))
    draws = draws.crossJoin(F.broadcast(total)).select("draw", F.pmod(number.cast("long"), F.col("total")).alias("place"))
    found = ends.join(F.broadcast(draws), (F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n")))
    found = found.select("draw", "bucket", (F.col("place") - F.col("end") + F.col("n") + 1).alias("at"))
    held = keyed.join(F.broadcast(found.select("bucket").distinct()), "bucket", "left_semi")
    ranked = held.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("key", "id")))
    return ranked.join(F.broadcast(found), ["bucket", "at"]).select("draw", "id")


def distractors(draws: DataFrame, pool: DataFrame, group_col: str, id_col: str = "id", settings: Settings = DEFAULT) -> DataFrame:
    """draw, oracle, n, id: for each draw (draw, id) the next passages of other groups, n from 1, without replacement.

    All passages lie on a ring, in the order of their hashes. A draw starts at a hash of its own and takes the first passages
    that are not of its oracle's group; where other groups have too few passages, other ids count, and too few of these is
    an error. So a passage is hashed once, and not for each draw: counts of the ring's sections tell
    how far each draw has to look, and only these sections meet the draws that look there. The draws are a
    stated set of `settings.oracles` rows; with the RING sections that bounds what is broadcast.
    """
    k = settings.distractors
    section = lambda key: F.conv(F.substring(key, 1, RING_DIGITS), 16, 10).cast("int")
    rows = pool.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), _key(settings.seed, F.col(id_col)).alias("key"))
    rows = rows.withColumn("section", section(F.col("key")))
    counts = rows.groupBy("section").agg(F.count("*").alias("all"))
    total = rows.agg(F.count("*").alias("total"))
    asked = rows.join(F.broadcast(draws.select("draw", "id")), "id")
    start = _key(settings.seed, F.lit("start"), F.col("draw"))
    asked = asked.select("draw", F.col("id").alias("oracle"), F.col("group").alias("g"), start.alias("start"))
    asked = asked.withColumn("first", section(F.col("start")))
    own = rows.join(F.broadcast(asked.select("g").distinct()), F.col("group").eqNullSafe(F.col("g")), "left_semi")
    own = own.groupBy("group", "section").agg(F.count("*").alias("own"))
    sizes = own.groupBy("group").agg(F.sum("own").alias("size")).withColumnRenamed("group", "g2")
    asked = asked.join(F.broadcast(sizes), F.col("g").eqNullSafe(F.col("g2"))).drop("g2").crossJoin(F.broadcast(total))  # one row
    asked = asked.withColumn("wide", F.col("total") - F.col("size") < k)
    asked = asked.withColumn("checked", F.when(F.col("total") - 1 < k, F.raise_error(F.lit("too few passages to draw from"))))
    asked = asked.where(F.col("checked").isNull()).drop("checked", "size", "total")

    # How far each draw looks: all sections up to the one that fills it, without counting the one where it starts.
    steps = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(RING - 1))).alias("step"))
    steps = steps.withColumn("section", (F.col("first") + F.col("step")) % RING).join(F.broadcast(counts), "section")
    mine = own.withColumnsRenamed({"group": "g2", "section": "s2"})
    steps = steps.join(F.broadcast(mine), F.col("g").eqNullSafe(F.col("g2")) & (F.col("section") == F.col("s2")), "left")
    others = F.when(F.col("step") == 0, 0).when(F.col("wide"), F.col("all")).otherwise(F.col("all") - F.coalesce("own", F.lit(0)))
    before = Window.partitionBy("draw").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("found", F.coalesce(F.sum(others).over(before), F.lit(0)))
    need = F.when(F.col("wide"), k + 1).otherwise(k)  # the oracle itself may be among those of a wide draw
    steps = steps.where(F.col("found") < need).select("section", "draw", "oracle", "g", "start", "wide")

    allowed = F.when(F.col("wide"), F.col("id") != F.col("oracle")).otherwise(~F.col("group").eqNullSafe(F.col("g")))
    met = rows.join(F.broadcast(steps), "section").where(allowed)
    order = Window.partitionBy("draw").orderBy(F.col("key") < F.col("start"), "key", "id")
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("draw", "oracle", "n", "id")
