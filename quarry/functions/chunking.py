"""Bounded, content-addressed chunks as column expressions: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Settings
from quarry.functions.text import let, strip


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Stripped parts between separators, without empty ones."""
    parts = F.split(text, rf"\Q{separator}\E", -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def windows(paragraph: Column, settings: Settings = DEFAULT) -> Column:
    """A paragraph that fits stays whole; a longer one gives overlapping windows, stripped, without empty ones."""
    size, step = settings.max_chars, settings.max_chars - settings.overlap
    last = F.ceil((F.length(paragraph) - size) / step).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: strip(F.substring(paragraph, i * step + 1, F.lit(size))),
    )
    return F.when(F.length(paragraph) <= size, F.array(paragraph)).otherwise(F.filter(cut, lambda p: p != ""))


def pack(pieces: Column, settings: Settings = DEFAULT, glue: str = "\n\n") -> Column:
    """Greedy packing of pieces, none of them empty: a piece joins the open chunk if both fit, else it opens the next one.

    The fold keeps numbers only, the first piece of each chunk; the chunks are then cut from the pieces.
    """
    return let(pieces, lambda held: _cut(held, _starts(held, settings, len(glue)), glue))


def _starts(pieces: Column, settings: Settings, between: int) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("open"), F.lit(0).alias("i"))

    def put(state, piece):
        joined = state["open"] + between + F.length(piece)
        opens = (state["i"] == 0) | (joined > settings.max_chars)
        return F.struct(
            F.when(opens, F.array_append(state["starts"], state["i"])).otherwise(state["starts"]).alias("starts"),
            F.when(opens, F.length(piece)).otherwise(joined).alias("open"),
            (state["i"] + 1).alias("i"),
        )

    return F.aggregate(pieces, start, put, lambda s: s["starts"])


def _cut(pieces: Column, starts: Column, glue: str) -> Column:
    def chunk(first, n, held):
        after = F.coalesce(F.get(held, n + 1), F.size(pieces))
        return F.array_join(F.slice(pieces, first + 1, after - first), glue)

    return let(starts, lambda held: F.transform(held, lambda first, n: chunk(first, n, held)))


def chunk_id(name: Column, number: Column, text: Column) -> Column:
    """Name, number of four digits or more, and the start of a hash of name and text."""
    digest = F.substring(F.sha1(F.concat(name, F.lit("\n"), text)), 1, 20)
    return F.concat(name, F.lit("_chunk_"), F.format_string("%04d", number), F.lit("_"), digest)


def chunks(
    docs: DataFrame, name: Column, text: Column, separator: str = "\n\n", settings: Settings = DEFAULT, keep: tuple = ()
) -> DataFrame:
    """id, doc_name, chunk_num, text for every chunk of every document; keep names columns that come along."""
    pieces = F.flatten(F.transform(paragraphs(text, separator), lambda p: windows(p, settings)))
    packed = docs.select(*keep, strip(name).alias("doc_name"), F.posexplode(pack(pieces, settings)).alias("chunk_num", "text"))
    return packed.select(chunk_id(F.col("doc_name"), F.col("chunk_num"), F.col("text")).alias("id"), *packed.columns)
