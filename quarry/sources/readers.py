"""Readers with explicit schemas."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import OTHER_BREAK, newlines, strip
from quarry.operators import order
from quarry.sources import versions

CHUNKS = "id string, pdf_name string, text string"
FROZEN_SOURCES = "qid int, chunk_ids array<string>"
FROZEN_CONTEXTS = "qid int, question string, sources array<struct<chunk_id string, pdf_name string, text string>>"
RAFT = "instruction string, input string, output string"
MANIFEST = "pdf_name string, source_org string, title string, date_accessed date, notes string"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A row per line. strict: bad JSON fails the job; else bad lines are left out. Blank lines never count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, doc_name, text of the *.md files of a folder, in text mode; order them by file_name."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.regexp_extract("file_name", r"^(.*)\.md$", 1)
    # The metadata holds the name as part of a URI.
    file_name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    rows = rows.select(file_name.alias("file_name"), newlines(F.col("value")).alias("text"))
    return rows.select("file_name", strip(name).alias("doc_name"), "text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), value of a text file, or of the files of a folder in the order of their names; lines end by any line break.

    Large files are read in splits: each counts its own lines, and the counts before it are added.
    """
    return _in_order(spark.read.text(path), F.split("value", OTHER_BREAK, -1), "line_no", F.lit(True))


def parts(spark: SparkSession, path: str, rule: str, wanted: Column | None = None) -> DataFrame:
    """part_no (from 1), value of what stands between the rules of text files, cut where a rule is also inside a large file.

    wanted: a condition on value; other parts have no number.
    """
    value = F.array(newlines(F.col("value")))
    return _in_order(spark.read.option("lineSep", rule).text(path), value, "part_no", F.lit(True) if wanted is None else wanted)


def _in_order(rows: DataFrame, values: Column, name: str, wanted: Column) -> DataFrame:
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = rows.select(split.alias("split"), F.explode(values).alias("value")).where(wanted)
    return order.offset(found, "split", name, start=1).select(name, "value")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_no (from 0), file_name, doc_name, text of the *.md files of a folder in the order of their names."""
    return order.numbered(markdown(spark, folder), ["file_name"], "doc_no").select("doc_no", "file_name", "doc_name", "text")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(newlines(F.col("value")).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The CSV manifest; blank lines don't count, padding of names stays."""
    return spark.read.schema(MANIFEST).option("header", True).option("escape", '"').csv(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that sinks.index keeps, or a plain Parquet table."""
    store = versions.Store(spark, path)
    found = versions.current(store)
    return spark.read.parquet(f"{store.top}/{found[1]['table']}" if found else path)


class Converter(Protocol):
    """Turns the bytes of a file into Markdown; raises if it can't."""

    def markdown(self, content: bytes) -> str: ...


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, content of the *.pdf files of a folder, not of its sub-folders; the reader leaves out empty files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def converted(files: DataFrame, converter: Converter) -> DataFrame:
    """file_name, text, error: a file that fails has an error in place of a text and stops nothing."""

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    texts.append(converter.markdown(content))
                    errors.append(None)
                except Exception as error:
                    texts.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["file_name", "text", "error"]
            )

    return files.select("file_name", "content").mapInArrow(run, "file_name string, text string, error string")


def html_markdown(html: Column) -> Column:
    """Readable text of an HTML page: no scripts, styles or tags; headings marked, blocks on lines of their own."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?is)<!--.*?-->|<!doctype[^>]*>", "")
    out = F.regexp_replace(out, r"(?i)<(h[1-6]|title)\b[^>]*>", "\n\n# ")
    out = F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"(?i)<(p|div|ul|ol|table|tr|section|article|nav|header|footer|br|/h[1-6]|/title|/p|/div)\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(character))
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    return strip(F.regexp_replace(out, r" ?\n[ \n]*\n ?| ?\n ?", "\n"))
