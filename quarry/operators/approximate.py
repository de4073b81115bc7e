"""An approximate vector index: coarse centroids, residual product codes, exact re-ranking.

Every row is indexed: it goes to the cell of its nearest centroid with a code of a byte for each part of what is left
of it. A search visits the `probes` cells nearest to a query, ranks their rows by the distance to the codes, and re-ranks the best of them by
their whole vectors. Centroids and code books are fitted to a sample of a bounded number of rows, picked by a hash of ids; the
cells of the whole table are cut into blocks of bounded size, so a cell that holds a third of all rows is many tasks.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.operators import nearest
from quarry.sources import versions

#: Rows that a fit may use, centroids at most, rows of a block, queries of a task.
SAMPLE, CENTROIDS, BLOCK, QUERIES = 20_000, 2048, 8192, 2048
CODES = 256


@dataclass
class Model:
    centroids: np.ndarray  # cells x dims
    books: list[np.ndarray]  # for each part: codes x its dims

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """Numbers of the n nearest centroids of each row, nearest first."""
        return np.argsort(nearest.distances(x, self.centroids), axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        parts = [nearest.distances(rest[:, a:b], book).argmin(1) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return np.stack(parts, 1).astype(np.uint8)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of what is left of queries to every code: queries x parts x codes."""
        out = np.zeros((len(rest), len(self.books), CODES))
        for i, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[:, i, : len(book)] = nearest.distances(rest[:, a:b], book) ** 2
        return out

    def dumped(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "books": [b.tolist() for b in self.books]})

    @classmethod
    def loaded(cls, text: str) -> Model:
        found = json.loads(text)
        return cls(np.array(found["centroids"], float), [np.array(b, float) for b in found["books"]])


def means(x: np.ndarray, k: int, rng: np.random.RandomState, rounds: int = 12) -> np.ndarray:
    """k means by Lloyd's rounds from rows at random; a mean without rows moves to a row that is far from its own."""
    x = np.asarray(x, float)
    k = min(k, len(np.unique(x, axis=0)))
    centres = np.unique(x, axis=0)[rng.permutation(len(np.unique(x, axis=0)))[:k]]
    for _ in range(rounds):
        far = nearest.distances(x, centres)
        own = far.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        lost = np.flatnonzero(n == 0)
        centres[lost] = x[np.argsort(-far.min(1), kind="stable")[: len(lost)]]
    return centres


def fit(corpus: DataFrame, parts: int = 8, centroids: int | None = None, sample: int = SAMPLE, seed: int = 42) -> Model:
    """A model of the vectors of corpus (id, vector), all of the length that most of the sample has. It is fitted to `sample` rows at most."""
    rows = nearest._sound(corpus.select("id", F.col("vector").cast("array<double>").alias("vector")))
    n = rows.count()
    spread = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30))
    some = rows.where(spread < max(1, (1 << 30) * 2 * sample // max(1, n))).orderBy(spread).limit(sample).select("vector").collect()
    if not some:
        raise ValueError("no vectors to fit an index to")
    lengths = np.array([len(r[0]) for r in some])
    dims = int(np.bincount(lengths).argmax())
    x = np.array([r[0] for r in some if len(r[0]) == dims], float)
    rng = np.random.RandomState(seed)
    model = Model(means(x, centroids or min(CENTROIDS, math.isqrt(n) + 1), rng), [])
    rest = x - model.centroids[model.cells(x)[:, 0]]
    edges = np.linspace(0, dims, min(parts, dims) + 1).astype(int)
    model.books = [means(rest[:, a:b], CODES, rng) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return model


def encoded(corpus: DataFrame, model: Model) -> DataFrame:
    """id, ord, cell, code of every row (id, ord, vector) that has the model's length."""
    dims = model.centroids.shape[1]
    rows = nearest._sound(corpus.select("id", "ord", F.col("vector").cast("array<double>").alias("vector"))).where(F.size("vector") == dims)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = np.asarray(part.column(2).flatten(), float).reshape(-1, dims)
                cell = model.cells(x)[:, 0]
                codes = [c.tobytes() for c in model.codes(x, cell)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(codes, pa.binary())], ["id", "ord", "cell", "code"])

    kinds = {c: corpus.schema[c].dataType.simpleString() for c in ("id", "ord")}
    return rows.mapInArrow(run, f"id {kinds['id']}, ord {kinds['ord']}, cell int, code binary")


def build(corpus: DataFrame, path: str, parts: int = 8, centroids: int | None = None, sample: int = SAMPLE) -> None:
    """Replace the index at a path, or make it: codes by cell, and the whole vectors, of corpus (id, ord, vector)."""
    spark = corpus.sparkSession
    store = versions.Store(spark, path)
    found = versions.current(store)
    model = fit(corpus, parts, centroids, sample)
    codes, whole = versions.fresh(store, "codes"), versions.fresh(store, "vectors")
    encoded(corpus, model).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{store.top}/{codes}")
    corpus.select("id", "ord", F.col("vector").cast("array<double>").alias("vector")).write.parquet(f"{store.top}/{whole}")
    manifest = {"folders": [codes, whole], "codes": codes, "vectors": whole, "model": model.dumped()}
    versions.commit(store, manifest, found and found[0])


class Index:
    def __init__(self, spark: SparkSession, path: str):
        store = versions.Store(spark, path)
        found = versions.current(store)
        if found is None:
            raise FileNotFoundError(f"no index at {path}; build it first")
        self.model = Model.loaded(found[1]["model"])
        self.codes = spark.read.parquet(f"{store.top}/{found[1]['codes']}")
        self.vectors = spark.read.parquet(f"{store.top}/{found[1]['vectors']}")


def candidates(queries: DataFrame, index: Index, wanted: int, probes: int) -> DataFrame:
    """qid, vector, id: for each query (qid, vector) the `wanted` rows of its `probes` nearest cells that are nearest by their codes."""
    model, dims = index.model, index.model.centroids.shape[1]
    asked = nearest._sound(queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))).where(F.size("vector") == dims)
    number = queries.schema["qid"].dataType.simpleString()

    def visits(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                cells = model.cells(np.asarray(part.column(1).flatten(), float).reshape(-1, dims), probes)
                take = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(cells.ravel(), pa.int32())], ["qid", "vector", "cell"])

    visited = asked.mapInArrow(visits, f"qid {number}, vector array<double>, cell int")
    # Both sides of a cell are dealt into blocks of bounded size, and each block of the one meets each of the other.
    n = index.codes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = visited.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks"))
    sizes = n.join(m, "cell")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = visited.join(sizes, "cell").select("cell", every("blocks").alias("i"), one("qid", "tasks").alias("j"), "qid", "vector")
    right = index.codes.join(sizes, "cell").select("cell", one("id", "blocks").alias("i"), every("tasks").alias("j"), "id", "code")
    own = index.codes.schema["id"].dataType.simpleString()

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        qid, ids = asked["qid"].combine_chunks(), held["id"].combine_chunks()
        at, columns, far = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        if asked.num_rows and held.num_rows:
            q = np.asarray(asked["vector"].combine_chunks().flatten(), float).reshape(-1, dims)
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
            rest = q - model.centroids[asked["cell"][0].as_py()]
            k = min(wanted, len(codes))
            for i in range(len(q)):
                table = model.tables(rest[i : i + 1])[0]
                rough = table[np.arange(codes.shape[1]), codes].sum(1)
                best = np.argpartition(rough, k - 1)[:k]
                at.append(np.full(k, i))
                columns.append(best)
                far.append(rough[best])
        return pa.table([qid.take(pa.array(np.concatenate(at))), ids.take(pa.array(np.concatenate(columns))), pa.array(np.concatenate(far))], names=["qid", "id", "rough"])

    found = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(run, f"qid {number}, id {own}, rough double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rough", "id"))
    best = found.withColumn("r", place).where(F.col("r") <= wanted).select("qid", "id")
    return best.join(asked, "qid")


def topk(queries: DataFrame, index: Index, k: int = DEFAULT.k_sem, wanted: int | None = None, probes: int = 16) -> DataFrame:
    """qid, id, ord, sem_rank, distance: k rows that are near to each of queries (qid, vector), as nearest.topk has them, most of them the nearest.

    `wanted` candidates (16 k) are ranked by whole vectors; distances and their ties are exact. Vectors of another length than the
    index's have no neighbours.
    """
    found = candidates(queries, index, wanted or 16 * k, probes).withColumnRenamed("vector", "asked").join(index.vectors, "id")
    far = F.aggregate(F.zip_with("asked", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    ranked = found.select("qid", "id", "ord", F.round(far, 9).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "ord", "id"))
    return ranked.withColumn("sem_rank", rank).where(F.col("sem_rank") <= k).select("qid", "id", "ord", "sem_rank", "distance")
