"""Embedding of texts, and exact nearest vectors for a few queries.

A few queries are broadcast; each batch of the corpus is compared with them by one product of matrices and hands on only
its own k nearest per query. More queries meet the corpus in a join (nearest).
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.config import DEFAULT
from quarry.functions import words
from quarry.operators import nearest

#: Queries that may be broadcast, and rows of a batch that are compared at a time.
BLOCK, ROWS = 4096, 2048
#: Texts that are encoded at a time.
PART = 1024


class Embedder(Protocol):
    """Turns texts into vectors of equal length."""

    dims: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class _Codes(dict):
    """A whole number for each token's bucket and sign, found when it is asked for first."""

    def __init__(self, place):
        super().__init__()
        self.place = place

    def __missing__(self, token: str) -> int:
        at, sign = self.place(token)
        if len(self) > 500_000:
            self.clear()
        found = self[token] = 2 * at + (sign > 0)
        return found


class HashingEmbedder:
    """Signed feature hashing of tokens by md5, to unit length. Not a semantic encoder: a stand-in that needs no model."""

    def __init__(self, dims: int = DEFAULT.dims):
        self.dims = dims
        self.codes = _Codes(self.place)

    def place(self, token: str) -> tuple[int, int]:
        digest = hashlib.md5(token.encode()).hexdigest()
        return int(digest[:8], 16) % self.dims, 1 if int(digest[8], 16) % 2 == 0 else -1

    def encode(self, texts: list[str]) -> np.ndarray:
        # Codes are found once for a token of the part, and all counted at once.
        out, width = np.zeros((len(texts), self.dims)), 2 * self.dims
        for start in range(0, len(texts), PART):
            part = texts[start : start + PART]
            sizes, found = words.coded(part)
            code = np.fromiter(map(self.codes.__getitem__, found.dictionary.to_pylist()), np.int64, len(found.dictionary))[found.indices.to_numpy()]
            counts = np.bincount(np.repeat(np.arange(len(part)) * width, sizes) + code, minlength=len(part) * width).reshape(len(part), self.dims, 2)
            out[start : start + len(part)] = counts[:, :, 1] - counts[:, :, 0]
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)


def embed(texts: DataFrame, embedder: Embedder, id_col: str = "id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id, the columns of keep, vector array<double>."""

    def run(batches):
        for batch in batches:
            found = embedder.encode(batch.column(1).to_pylist())
            flat = pa.array(found.ravel())
            vectors = pa.ListArray.from_arrays(np.arange(0, found.size + 1, embedder.dims, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], vectors], [id_col, *keep, "vector"])

    kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))
    return texts.select(id_col, F.col(text_col).alias("_text"), *keep).mapInArrow(run, f"{kinds}vector array<double>")


def topk(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT.k_sem) -> DataFrame:
    """qid, id, sem_rank, distance: the k nearest of corpus (id, ord, vector) to each of queries (qid, vector).

    Squared Euclidean distance in double precision; those that agree to 9 digits are ties, by corpus order. Null and
    empty vectors, and those of another length, have no neighbours. BLOCK queries or fewer are broadcast and the corpus is read once, without a
    shuffle; more of them are joined by nearest.topk.
    """
    rows = [(q, np.asarray(v, float)) for q, v in queries.select("qid", "vector").limit(BLOCK + 1).collect() if v and None not in v]
    if len(rows) > BLOCK:
        return nearest.topk(queries, corpus, k)
    block = queries.sparkSession.sparkContext.broadcast(rows)
    kind = queries.schema["qid"].dataType.simpleString()
    own, order = corpus.schema["id"].dataType.simpleString(), corpus.schema["ord"].dataType.simpleString()
    number = to_arrow_type(queries.schema["qid"].dataType)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield from _nearest(batch.slice(start, ROWS), block.value, k, number)

    found = corpus.select("id", "ord", "vector").mapInArrow(run, f"qid {kind}, id {own}, ord {order}, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "ord"))
    ranked = found.withColumn("sem_rank", rank).where(F.col("sem_rank") <= k)
    return ranked.select("qid", "id", "ord", "sem_rank", "distance")


def _nearest(batch: pa.RecordBatch, queries: list, k: int, number: pa.DataType):
    listed = batch.column(2)
    sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    for dims in {len(v) for _, v in queries}:
        at = np.flatnonzero(sizes == dims)
        flat = listed.take(pa.array(at)).flatten()
        if flat.null_count:
            good = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(1)
            at = at[good]
            flat = listed.take(pa.array(at)).flatten()
        asked = [(q, v) for q, v in queries if len(v) == dims]
        if not len(at) or not asked:
            continue
        x, q = flat.to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float), np.stack([v for _, v in asked])
        order = batch.column(1).take(pa.array(at)).to_numpy(zero_copy_only=False)
        rows, columns, exact = nearest.nearest_of(q, x, order, k)
        take = pa.array(at[columns])
        yield pa.RecordBatch.from_arrays(
            [pa.array([asked[i][0] for i in rows], number), batch.column(0).take(take), batch.column(1).take(take), pa.array(exact)],
            ["qid", "id", "ord", "distance"],
        )
