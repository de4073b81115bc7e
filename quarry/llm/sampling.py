"""Bounded samples of labelled rows for the fitted operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit may use. A documented bound; statistics of a corpus never go through it.
MAX_TRAIN_ROWS = 20_000


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = MAX_TRAIN_ROWS,
) -> DataFrame:
    """text and label of about `limit` labelled documents at most, picked by a hash of their ids.

    Labels that are null or neither 0 nor 1, and null ids, are left out; of an id's several labels the
    highest counts, and of an id's several texts one, so repeated rows don't raise the bound. The ids are few, so they
    are broadcast to the documents.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & usable)
    rows = rows.groupBy(F.col(id_col).alias("k")).agg(F.max(label).alias("label"))
    n = rows.count()
    span = 1 << 31
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(span)) < int(span * limit / n))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(rows), "k").groupBy("k", "label")
    return found.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("k", "text", "label")
