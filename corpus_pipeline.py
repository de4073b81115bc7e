"""A training corpus from the documents table, in five stages.

Every stage is written as Parquet to the shared folder and read again, so it starts from a table
and not from a lineage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, decontaminate, minhash, quality, suffix_dedup
from quarry.llm.common import table, written
from quarry.llm.queries import VOCABULARY, quality_model

#: Score below which a document is rejected.
QUALITY = 0.7
#: Repeated strings go from so many bytes on, whatever words they have, and from so many words on (over 50), whatever bytes they have.
PASSAGE_BYTES, PASSAGE_WORDS = 400, 51


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted to labelled documents of the whole table."""
    return quality.accepted(docs, quality_model(spark, sf_dir), QUALITY)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return minhash.representatives(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 400 bytes or of over 50 words that stand elsewhere too; n_chars follows."""
    out = suffix_dedup.without_repeats(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of what they decode to."""
    outputs = ("ids", "ids_sha256", "decoded_sha256")
    return byte_bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, outputs=outputs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("passage_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("tokens", tokens),
]

#: Neither the classifier nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
