"""A learned encoder: latent semantic analysis by a randomised range finder.

Texts are rows of a matrix of weighted terms, which is written once as numbers of terms and weights. A first pass over it gives the matrix times its transpose times a random
matrix, whose orthonormal basis holds the strongest directions of terms; a second pass projects the rows on that basis and adds up their
small Gram matrix, whose eigenvectors turn the basis into the directions themselves. Each further pass sharpens the basis. Tasks add
up rows of a bounded vocabulary, and Spark adds the tasks' sums by term.

The vocabulary and with it the model are bounded by parameters; every text is counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.functions.text import TOKEN
from quarry.operators import bm25
from quarry.sources.scratch import Workspace

#: Terms of the vocabulary, and directions that are sought besides the wanted ones.
TERMS, EXTRA = 32_768, 16
#: Texts whose products are held at a time.
ROWS = 256
#: Entries whose products are made at a time, so that they stay in a processor's cache.
PART = 1024
_TOKEN = re.compile("[a-z0-9]+")


def weighted(listed: pa.Array, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each distinct known term of lists of tokens: 1 + ln tf times idf, rows to unit length."""
    lengths = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(listed)), lengths)
    at = pc.index_in(listed.flatten(), value_set=terms)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    key, tf = np.unique(row[known] * len(terms) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
    row, term = key // max(1, len(terms)), key % max(1, len(terms))
    weight = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(listed)))
    return row, term, weight / norm[row]


def product(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """n rows, given by their weights (sorted by row), times a matrix of terms."""
    out = np.zeros((n, matrix.shape[1]))
    for low, high in _parts(row):
        r = row[low:high]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(matrix[term[low:high]] * weight[low:high, None], first)
    return out


def _parts(of: np.ndarray):
    """Ends of parts of PART entries."""
    return ((low, min(low + PART, len(of))) for low in range(0, len(of), PART))


@dataclass
class LsaEmbedder:
    """Texts to unit vectors; one without a known term has the zero vector. An Embedder of vectors.embed."""

    terms: list[str]
    idf: np.ndarray
    directions: np.ndarray  # terms x dims
    strengths: np.ndarray  # singular values
    dims: int = field(init=False)

    def __post_init__(self):
        self.dims = self.directions.shape[1]

    def encode(self, texts: list[str]) -> np.ndarray:
        listed = pa.array([_TOKEN.findall((t or "").lower()) for t in texts], pa.list_(pa.string()))
        parts, names = [np.zeros((0, self.dims))], pa.array(self.terms, pa.string())
        for start in range(0, len(listed), ROWS):
            part = listed.slice(start, ROWS)
            parts.append(product(*weighted(part, names, self.idf), len(part), self.directions))
        out = np.concatenate(parts)
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 1e-12)


def vocabulary(corpus: DataFrame, limit: int = TERMS, text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The `limit` terms that most texts hold, and their idf."""
    n = corpus.where(F.rlike(F.lower(F.col(text_col)), F.lit(TOKEN))).count()
    df = bm25.frequencies(corpus, text_col).where("term is not null")
    rows = df.orderBy(F.desc("n"), "term").limit(limit).collect()
    return [r["term"] for r in rows], np.log(1 + n / np.array([r["n"] for r in rows], float))


def _encoded(corpus: DataFrame, terms: list[str], idf: np.ndarray, text_col: str) -> DataFrame:
    """at, w: numbers and weights of each text's distinct known terms; texts without one are left out."""
    held = corpus.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches):
        names, scale = pa.array(held.value[0], pa.string()), held.value[1]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                found = pa.array(bm25.listed(batch.column(0).slice(start, ROWS).to_pylist()), pa.list_(pa.string()))
                row, term, weight = weighted(found, names, scale)
                ends = np.r_[np.flatnonzero(np.r_[True, np.diff(row) != 0]), len(row)].astype(np.int32) if len(row) else np.zeros(1, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight))], ["at", "w"]
                )

    return corpus.select(text_col).mapInArrow(run, "at array<int>, w array<double>")


def _entries(batches):
    """Row, term and weight, and the number of rows, of ROWS encoded texts (at, w) at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            size = part.column(0).value_lengths().to_numpy()
            yield np.repeat(np.arange(len(size)), size), part.column(0).flatten().to_numpy(), part.column(1).flatten().to_numpy(), len(size)


def _spread(texts: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """The encoded texts' matrix, transposed, times itself times a matrix of terms."""
    width, held = matrix.shape[1], texts.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        matrix = held.value
        total = np.zeros_like(matrix)
        for row, term, weight, n in _entries(batches):
            rows = product(row, term, weight, n, matrix)
            order = np.argsort(term, kind="stable")
            t, r, w = term[order], row[order], weight[order, None]
            for low, high in _parts(t):
                first = np.flatnonzero(np.r_[True, np.diff(t[low:high]) != 0])
                total[t[low:high][first]] += np.add.reduceat(rows[r[low:high]] * w[low:high], first)
        used = np.flatnonzero(total.any(1))
        for part in np.array_split(used, max(1, len(used) // 1024)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.ListArray.from_arrays(np.arange(0, len(part) * width + 1, width, dtype=np.int32), pa.array(total[part].ravel()))],
                ["term", "z"],
            )

    sums = [F.sum(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(width)]
    found = texts.mapInArrow(run, "term bigint, z array<double>").groupBy("term").agg(*sums).toPandas()
    out = np.zeros_like(matrix)
    out[found["term"].to_numpy()] = found.drop(columns="term").to_numpy()
    return out


def _gram(texts: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of the encoded texts' rows in a basis."""
    width, held = basis.shape[1], texts.sparkSession.sparkContext.broadcast(basis)

    def run(batches):
        total = np.zeros((width, width))
        for row, term, weight, n in _entries(batches):
            rows = product(row, term, weight, n, held.value)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    sums = [F.sum(F.get("g", F.lit(j))).alias(f"g{j}") for j in range(width)]
    found = texts.mapInArrow(run, "i bigint, g array<double>").groupBy("i").agg(*sums).toPandas().sort_values("i")
    return found.drop(columns="i").to_numpy() if len(found) else np.zeros((width, width))


def fit(
    corpus: DataFrame, dims: int = DEFAULT.dims, terms: int = TERMS, extra: int = EXTRA, sharpen: int = 1, seed: int = DEFAULT.seed, text_col: str = "text"
) -> LsaEmbedder:
    """An encoder of corpus's texts. dims, terms and extra bound the model and what a task and the driver hold.

    Null and empty texts add nothing. With fewer terms than dims the vectors are as long as there are terms; without any term it is an error.
    sharpen: further passes. Equal texts and seeds give equal vectors up to rounding.
    """
    known, idf = vocabulary(corpus, terms, text_col)
    if not known:
        raise ValueError("no text holds a term")
    # Terms are found and weighted once: all passes read their numbers.
    work = Workspace(corpus.sparkSession)
    texts = work.written(_encoded(corpus, known, idf, text_col), "encoded")
    basis = np.random.RandomState(seed).standard_normal((len(known), min(len(known), dims + extra)))
    for _ in range(1 + sharpen):
        basis, _ = np.linalg.qr(_spread(texts, basis))
    values, vectors = np.linalg.eigh(_gram(texts, basis))
    work.clear()
    order = np.argsort(-values)[: min(dims, len(known))]
    directions = basis @ vectors[:, order]
    # A direction and its opposite are the same; the largest part of each is positive.
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    return LsaEmbedder(known, idf, directions * np.where(signs == 0, 1, signs), np.sqrt(np.maximum(values[order], 0)))
