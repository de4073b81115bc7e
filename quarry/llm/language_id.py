"""Language identification by compression with per-language zstandard dictionaries.

For each language a raw-content dictionary is made of sample texts. A text is
reduced to its lower-cased letters, cut into blocks, and each block is compressed
with each dictionary; the language with the fewest bytes over all blocks is the
prediction. The margin is the share of bytes that the runner-up needs more; a
prediction with a narrower margin than asked for is marked as rejected.

Defined cases: a text that is null, empty or without any letter is `und` with score
0; equal sizes go to the language that comes first by name; without any labelled
sample every text is `und`. Rows are independent, so repeated rows give equal
results; an empty table gives an empty one; texts of any length are scored whole;
further columns are not looked at.
"""

from __future__ import annotations

import math
import re
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, ddl, pieces, written

#: Distinct labelled texts of each language that may go into its dictionary, and the dictionary's bytes.
SAMPLE_ROWS = 1000
DICTIONARY_BYTES = 256 << 10
#: Characters of a sample text that may go into a dictionary, in so many slices spread over the whole text.
SAMPLE_CHARS, SLICES = 2048, 8
#: Bytes of a slice in a dictionary, at least.
SLICE_BYTES = 64
#: Bytes of all dictionaries: every language is learned, beyond 500 languages with smaller dictionaries.
ALL_BYTES = 500 * DICTIONARY_BYTES
#: Languages whose rates may be broadcast.
BROADCAST_ROWS = 100_000
BLOCK_BYTES = 4096
LEVEL = 3
MARGIN = 0.01

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased letters with one space between runs; empty if there is none."""
    line = _OTHER.sub(" ", (text or "").lower()).strip()
    return line if any(map(str.isalpha, line)) else ""


def _spread(text: Column) -> Column:
    """The text, or where it is longer than SAMPLE_CHARS, slices from its start to its end."""
    size = SAMPLE_CHARS // SLICES
    step = (F.length(text) - size) / (SLICES - 1)
    parts = [F.substring(text, (F.lit(k) * step).cast("int") + 1, F.lit(size)) for k in range(SLICES)]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *parts))


def _slices(data: bytes, share: int) -> bytes:
    """The bytes, or as many as `share` of them in slices from their start to their end."""
    if len(data) <= share:
        return data
    n = max(1, share // SLICE_BYTES)
    size = share // n
    starts = [(len(data) - size) * k // (n - 1) for k in range(n)] if n > 1 else [(len(data) - size) // 2]
    return b"".join(data[a : a + size] for a in starts)


def _dictionary(texts: list[bytes], limit: int) -> bytes:
    """All texts, of those that are too long for an equal share of the limit only slices; what short ones leave goes to the others."""
    taken, room = {}, limit
    for done, k in enumerate(sorted(range(len(texts)), key=lambda k: len(texts[k]))):
        taken[k] = _slices(texts[k], max(1, room // (len(texts) - done) - 1))
        room = max(0, room - len(taken[k]) - 1)
    return b" ".join(taken[k] for k in range(len(texts)))[:limit]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from a bounded sample: about SAMPLE_ROWS distinct texts of each language, picked by a hash of the text."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = written(counts, "languages")
    n_languages = counts.count()
    limit = min(DICTIONARY_BYTES, max(1, ALL_BYTES // max(1, n_languages)))
    span = 1 << 31
    rates = counts.select(F.col("lang").alias("_lang"), (F.least(F.lit(1.0), F.lit(float(SAMPLE_ROWS)) / F.col("n")) * span).cast("long").alias("below"))
    rates = F.broadcast(rates) if n_languages <= BROADCAST_ROWS else rates
    pick = F.pmod(F.col("h"), F.lit(span))
    keep = (F.col("lang") == F.col("_lang")) & (pick < F.col("below"))
    sample = rows.join(rates, keep).select("lang", _spread(F.col("t")).alias("t"), pick.alias("k")).distinct()
    out = {}
    for lang, found in groupby(sample.orderBy("lang", "k", "t").toLocalIterator(), key=lambda r: r["lang"]):
        listed = [t.encode() for t in (letters(r["t"]) for r in found) if t]
        if listed:
            out[lang] = _dictionary(listed, limit)
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.compress = []
        for lang, data in sorted(dictionaries.items()):
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            compressor = zstandard.ZstdCompressor(
                level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.compress.append((lang, compressor.compress))

    def sizes(self, line: str) -> list[tuple[int, str]]:
        data = line.encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return sorted((sum(len(run(b)) for b in blocks), lang) for lang, run in self.compress)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        line = letters(text)
        if not line or not self.compress:
            return "und", 0.0, 0.0
        sizes = self.sizes(line)
        best = sizes[0][0]
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        # Bits saved against each other language as log odds, tempered by the text's length.
        unit = max(4.0, 0.02 * best)
        weight = sum(math.exp(-min(700.0, (size - best) / unit)) for size, _ in sizes)
        return sizes[0][1], 1.0 / weight, (sizes[1][0] - best) / best


_built: dict[int, Classifier] = {}


def predict(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    margin: float = MARGIN,
) -> DataFrame:
    """A row per document: id, lang_pred, score (0 to 1), margin, rejected (margin narrower than asked for)."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # ALL_BYTES at most

    def run(batches):
        key = hash(tuple(sorted(held.value.items())))
        if key not in _built:
            _built.clear()
            _built[key] = Classifier(held.value)
        classify = _built[key].predict
        for part in pieces(batches, text_col):
            found = [classify(text) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                    pa.array([x[2] < margin for x in found], pa.bool_()),
                ],
                ["id", "lang_pred", "score", "margin", "rejected"],
            )

    schema = f"`{id_col}` {ddl(docs, id_col)}, lang_pred string, score double, margin double, rejected boolean"
    return bounded(docs).select(id_col, text_col).mapInArrow(run, schema)
