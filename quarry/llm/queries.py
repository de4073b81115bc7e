"""The queries of the training-data operators: thin wrappers that derive the contracted columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import (
    byte_bpe,
    decontaminate,
    filter_audit,
    grid_join,
    language_id,
    license_scan,
    line_dedup,
    minhash,
    oracle,
    quality,
    retention,
    suffix_dedup,
    toxicity,
    url_filter,
    url_list,
)
from quarry.llm.common import fold, table
from quarry.llm.sampling import labelled_sample

#: Passages of so many words (over 50) that stand twice go from a document's text, whatever bytes they have.
PASSAGE_WORDS = 51
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_grid_join(spark, sf_dir):
    return grid_join.similar_vectors(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.train(docs.where(fold("doc_id", 4) != 2))
    found = language_id.predict(docs, dictionaries)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_suffix_dedup(spark, sf_dir):
    shown = ("kept_sha256", "n_passage_bytes", "text")
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS, shown=shown)


def op5_url_filter(spark, sf_dir):
    start = F.lit("2024-01-01").cast("timestamp")
    day = lambda c: F.timestamp_add("DAY", c.cast("int"), start)
    entries = spark.createDataFrame(url_list.entries(), "key string, category string, allow boolean, listed boolean, day int")
    entries = entries.select("key", "category", "allow", "listed", day(F.col("day")).alias("at"))
    captures = table(spark, sf_dir, "pages").withColumn("fetched", day(F.pmod("page_id", F.lit(url_list.DAYS))))
    return url_filter.evaluate(captures, entries, keep=("page_id",))


def op6_byte_bpe(spark, sf_dir):
    outputs = ("ids_sha256", "decoded_sha256")
    return byte_bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, outputs=outputs)


def op7_decontaminate(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def quality_model(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.fit(labelled_sample(docs, labels, "quality", fold("doc_id", 4) != 2))


def op8_quality(spark, sf_dir):
    found = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", fold("doc_id", 5) != 0))
    found = toxicity.passages(docs, model)
    return found.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark, sf_dir):
    found = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_retention(spark, sf_dir):
    return retention.matrix(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


def queries() -> dict:
    return {
        "op1_grid_join": op1_grid_join,
        "op2_language_id": op2_language_id,
        "op3_license_scan": op3_license_scan,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_decontaminate": op7_decontaminate,
        "op8_quality": op8_quality,
        "op9_toxicity": op9_toxicity,
        "op10_minhash": op10_minhash,
        "op11_filter_audit": op11_filter_audit,
        "op12_line_dedup": op12_line_dedup,
        "op13_retention": op13_retention,
    }


def oracle_sql() -> dict:
    return {"op5_url_filter": url_list.oracle(), **oracle.ORACLE}
