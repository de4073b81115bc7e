"""Connected components of a table of links, by alternating star contractions.

Each round turns every vertex towards the smallest of its neighbours, first for larger
neighbours, then for smaller ones; the links that stay when nothing changes are stars whose
centre is the smallest vertex of a component. Rounds grow with the logarithm of the longest
path. A round's minima are aggregated before they are shuffled, and its links are written
to the shared folder, so neither a vertex of high degree nor a lost executor hurts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dropped, written


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    turned = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.where("u <> v")


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    turned = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return turned.unionByName(own).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """vertex, root (the smallest vertex reachable) of every vertex but the roots, from links u, v."""
    now = written(links.select("u", "v").where("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        after = written(_small(_large(now)), "links")
        dropped(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
