"""Questions to cited answers over an index that is built once and read by every call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Settings
from quarry.functions.text import strip
from quarry.operators import fusion, generate, postings, prompts, vectors


def build(chunks: DataFrame, path: str, embedder: vectors.Embedder | None = None, settings: Settings = DEFAULT) -> None:
    """Replace the index at a path by chunks (id, ord, pdf_name, text): their texts, vectors and postings."""
    postings.build(chunks, path, added=_embedding(embedder, settings))


def append(chunks: DataFrame, path: str, embedder: vectors.Embedder | None = None, settings: Settings = DEFAULT) -> None:
    """Add chunks to the index as a segment; answers are those of an index that is built of all."""
    postings.append(chunks, path, added=_embedding(embedder, settings))


def merge(spark: SparkSession, path: str) -> None:
    """Make one segment of all; answers stay the same."""
    postings.merge(spark, path)


def _embedding(embedder: vectors.Embedder | None, settings: Settings) -> Callable[[DataFrame], DataFrame]:
    embedder = embedder or vectors.HashingEmbedder(settings.dims)
    return lambda chunks: vectors.embed(chunks, embedder, "id", "text", keep=("ord", "pdf_name", "text"))


def opened(spark: SparkSession, path: str) -> postings.Index:
    """The index as it is now; an error if there is none."""
    return postings.Index(spark, path)


def asked(questions: DataFrame) -> DataFrame:
    """Questions (qid, question) that hold more than blanks; the others are not answered."""
    return questions.where(strip(F.coalesce("question", F.lit(""))) != "")


def prompted(questions: DataFrame, path: str, kind: str = "cli", embedder: vectors.Embedder | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """qid, question, sources (rank, chunk_id, pdf_name, text), prompt, by hybrid retrieval from the index; no text of it is tokenised."""
    embedder = embedder or vectors.HashingEmbedder(settings.dims)
    index, real = opened(questions.sparkSession, path), asked(questions)
    chunks = index.chunks()
    near = vectors.topk(vectors.embed(real, embedder, "qid", "question"), chunks, settings.k_sem)
    fused = fusion.rrf(near, postings.topk(real, index, settings.k_bm25, settings=settings), settings)
    found = fusion.with_texts(fused, chunks, ("pdf_name", "text"), settings)
    source = F.struct("rank", F.col("id").cast("string").alias("chunk_id"), "pdf_name", "text")
    found = found.groupBy("qid").agg(F.array_sort(F.collect_list(source)).alias("sources")).join(real, "qid")
    return found.select("qid", "question", "sources", prompts.question_prompt(kind, F.col("question"), F.col("sources")).alias("prompt"))


def answers(
    questions: DataFrame, path: str, generator: generate.Generator, kind: str = "cli", on_error: str = "inline", settings: Settings = DEFAULT
) -> DataFrame:
    """qid, question, model, answer."""
    rows = prompted(questions, path, kind, settings=settings).select("prompt", "qid", "question")
    return generate.answers(rows, generator, keep=("qid", "question"), on_error=on_error)
