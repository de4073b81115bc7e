"""Repeated lines: a line that stands in several documents stays in the last of them only.

Lines are exploded as (document, position, hash of the normalised line). Documents of a hash are counted over
distinct pairs, so a line that stands everywhere is combined on the map side before it moves; hashes that reach the threshold go back to
their lines, and the positions found are taken out of the document. Texts move once, in the last join.
DataFrame functions only.

Results at the edges:
* a null text is an empty one, and an empty one is a single empty line;
* rows with one id are one document when documents are counted, and each is rewritten on its own; rows that are equal get equal results;
* rows without an id are no document: they add nothing to a count and lose lines that others repeat;
* an empty table gives an empty table;
* further columns come along, whatever their names; the two counts replace columns of their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let

MIN_CHARS, MIN_DOCS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
#: Characters beyond ASCII that may have a lower case: all but small and caseless letters, marks, punctuation, blanks, digits and most symbols.
CASED = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Z}\p{Nd}\p{Sc}\p{Sm}\p{Sk}]"
#: Parts of a line's documents in the join with repeated lines, for lines that stand everywhere.
SALTS = 16


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else: as lower() does it where no other character has a lower case."""
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(CASED))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest(text: Column) -> Column:
    """16 bytes of SHA-256, of null too, so that no filter has to compute it again to look for nulls."""
    return F.coalesce(F.unhex(F.substring(F.sha2(text, 256), 1, 32)), F.lit(b""))


def exploded(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, body (a hash of the whole text), pos, line (a hash) of every line of at least min_chars."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The whole text is hashed below the generator, once and not for each line.
    whole = docs.select(F.col(id_col).alias("doc"), digest(text).alias("body"), text.alias("text"))
    found = whole.select("doc", "body", F.posexplode(lines(F.col("text"))).alias("pos", "raw"))
    bare = F.btrim(F.col("raw"), F.lit(BLANKS))
    # Lower case has as many code points, so lines that are too short are left out before it is made.
    return found.where(F.length(bare) >= min_chars).select("doc", "body", "pos", let(bare, lambda x: digest(lowered(x))).alias("line"))


def repeated(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """line, last of the hashes that at least min_docs documents hold, with the largest of their ids."""
    pairs = found.where("doc is not null").select("line", "doc").distinct()
    counted = pairs.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last"))
    return counted.where(F.col("n_docs") >= min_docs).select("line", "last")


def _without(parts: Column, gone: Column) -> Column:
    """An array without the elements at some places (from 0, sorted): the slices between them, in one pass."""
    n = F.size(gone)
    start = lambda i: F.when(i > 0, F.try_element_at(gone, i) + 1).otherwise(F.lit(0))
    stop = lambda i: F.when(i < n, F.try_element_at(gone, i + 1)).otherwise(F.size(parts))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(parts, start(i) + 1, stop(i) - start(i))))


def without_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with the rest of each text, and n_lines (before) and n_dropped.

    Lines whose key has min_chars code points or more and stands in min_docs documents or more go from all of them
    but the one with the largest id, where all of its lines stay.
    """
    found = exploded(docs, min_chars, id_col, text_col)
    salted = repeated(found, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = found.withColumn("salt", F.pmod(F.xxhash64("doc", "body"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"])
    gone = gone.where(~F.col("doc").eqNullSafe(F.col("last")))
    # A set, as rows may be repeated; its size is bounded by the lines of one text.
    gone = gone.groupBy("doc", "body").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("of"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("own"))
    same = F.col("of").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("body"))
    joined = rows.join(gone, same, "left")
    text = F.col(f"row.`{text_col}`")
    rest = F.when(
        F.col("gone").isNotNull(), let(lines(text), lambda parts: F.array_join(_without(parts, F.col("gone")), "\n"))
    ).otherwise(F.coalesce(text, F.lit("")))
    counts = {"n_lines": F.size(lines(text)).cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    kept = [rest.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in counts]
    return joined.select(*kept, *(value.alias(name) for name, value in counts.items()))
