"""Reciprocal rank fusion, and hybrid retrieval on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Settings
from quarry.operators import bm25, vectors
from quarry.sources.scratch import scratch

#: Ranked rows that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def rrf(semantic: DataFrame, keyword: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """qid, id, sem_rank, bm25_rank, score, rank of every id in either list.

    Ties go to the semantic list first, each list in its own order.
    """
    both = semantic.select("qid", "id", "sem_rank").join(keyword.select("qid", "id", "bm25_rank"), ["qid", "id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(settings.rrf_k)) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("sem_rank") + part("bm25_rank"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("sem_rank"), "bm25_rank")
    return scored.withColumn("rank", F.row_number().over(order))


def hybrid(
    questions: DataFrame, corpus: DataFrame, embedder: vectors.Embedder | None = None, settings: Settings = DEFAULT
) -> DataFrame:
    """All fused candidates of each question (qid, question) from a corpus (id, ord, text)."""
    embedder = embedder or vectors.HashingEmbedder(settings.dims)
    asked = vectors.embed(questions, embedder, "qid", "question")
    indexed = vectors.embed(corpus, embedder, "id", "text", keep=("ord",))
    return rrf(
        vectors.topk(asked, indexed, settings.k_sem), bm25.topk(questions, corpus, settings.k_bm25, settings=settings), settings
    )


def with_texts(fused: DataFrame, corpus: DataFrame, keep: tuple = ("text",), settings: Settings = DEFAULT) -> DataFrame:
    """The first final_k of each question with columns of the corpus. Unknown ids drop out after the cut, so fewer may be left.

    The ranked side is written, counted, and broadcast if it has BROADCAST_ROWS rows or fewer.
    """
    spark, path = corpus.sparkSession, scratch(corpus.sparkSession, "fused")
    fused.where(F.col("rank") <= settings.final_k).write.parquet(path)
    best = spark.read.schema(fused.schema).parquet(path)
    few = best.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return corpus.select("id", *keep).join(F.broadcast(best) if few else best, "id")
