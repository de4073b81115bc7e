"""Exact nearest vectors by a join: pivots, Voronoi cells with rings, bounds by the triangle inequality.

Vectors go to the cell of their nearest pivot. A cell is cut into blocks along the distance to its pivot, so a block is a
ring with an inner and an outer radius and a bounded number of rows; equal distances are split by a hash, so a vector that is
repeated without end fills many blocks. A query first meets the nearest blocks of its own cell, which gives an upper bound for its k-th
distance; then it meets every block whose ring, or whose side of the plane between two pivots, may hold something nearer.

Queries and vectors meet in tasks of bounded size by a shuffle. Only the pivots are broadcast: a sample of a bounded
number that decides what is skipped, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import DEFAULT
from quarry.sources.scratch import Workspace, result

#: Rows of a block, queries of a task, and the largest number of pivots.
BLOCK, QUERIES, PIVOTS = 2048, 2048, 4096
#: Room for rounding where distances are compared with bounds.
SLACK = 1e-6
#: The cell of vectors whose length has no pivot.
NO_CELL = -1
KINDS = {"int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def _sound(rows: DataFrame) -> DataFrame:
    """Rows whose vector has elements and only finite ones."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("vector") > 0) & ~F.coalesce(bad, F.lit(False)))


def _with(rows: DataFrame, **more: str) -> T.StructType:
    """The schema of rows with further columns."""
    return T.StructType([*rows.schema.fields, *(T.StructField(n, KINDS[kind]) for n, kind in more.items())])


def pivots(corpus: DataFrame, limit: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by length of vector: about twice the root of the number of rows, `limit` at most, picked by a hash of their ids."""
    n = corpus.count()
    wanted = min(limit, 2 * math.isqrt(n) + 1)
    spread = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30))
    some = corpus.where(spread < max(1, (1 << 30) * 4 * wanted // max(1, n))).orderBy(spread).limit(wanted)
    found: dict[int, list] = {}
    for r in some.select("vector").collect():
        found.setdefault(len(r[0]), []).append(r[0])
    return {d: np.unique(np.array(v, float), axis=0) for d, v in found.items()}


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots. The expanded form loses digits near 0, which SLACK makes up for."""
    square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def _by_length(column: pa.Array):
    """Row numbers and matrix of each length of vector in a column."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for dims in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dims)
        yield dims, rows, flat[starts[rows][:, None] + np.arange(dims)]


def assigned(rows: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """rows with dims, cell (number of the nearest pivot of that length) and away (the distance to it)."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            dims, cell, away = (np.zeros(batch.num_rows, t) for t in (np.int32, np.int32, float))
            for d, at, x in _by_length(column):
                dims[at], cell[at] = d, NO_CELL
                if d in known:
                    for part in np.array_split(np.arange(len(at)), max(1, len(at) // 1024)):
                        far = distances(x[part], known[d])
                        cell[at[part]] = far.argmin(1)
                        away[at[part]] = far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(away)], [*batch.schema.names, "dims", "cell", "away"])

    return rows.mapInArrow(run, _with(rows, dims="int", cell="int", away="double"))


def blocks(rows: DataFrame, work: Workspace, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows with block, blocks: block, dims, cell, n, lo, hi).

    Rings are cut at estimated quantiles of a cell's distances, so they are of like size however distances are spread, and a ring that
    is too large all the same, as its distances are equal, is split by a hash of the ids.
    """
    sizes = rows.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.percentile_approx("away", [i / 64 for i in range(1, 64)], 1000).alias("q"))
    # As many cuts as the cell has blocks, 64 at most; larger rings are split by hash.
    many = F.least(F.lit(64), F.ceil(F.col("n") / size)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), many - 1), lambda i: F.element_at("q", (i * 64 / many).cast("int")))
    sizes = sizes.select("dims", "cell", F.when(many > 1, F.array_distinct(cuts)).otherwise(F.array().cast("array<double>")).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("away")))
    placed = rows.join(sizes, ["dims", "cell"]).withColumn("ring", ring).drop("cuts")
    # Written, as estimates may differ when they are made again.
    placed = work.written(placed, "rings")
    counts = placed.groupBy("dims", "cell", "ring").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
    split = placed.join(counts, ["dims", "cell", "ring"]).withColumn("block", F.struct("dims", "cell", "ring", part.alias("part"))).drop("ring", "parts")
    split = work.written(split, "blocks")
    listed = split.groupBy("block", "dims", "cell").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"))
    return split, work.written(listed, "listed")


def _cells(queries: DataFrame, known: dict[int, np.ndarray], reach: dict[tuple[int, int], tuple[int, float]], k: int) -> DataFrame:
    """qid, dims, cell, own (of the nearest cell), away, plane and roof: each query with the cells it may have to visit.

    plane: how far the cell's side of the plane between the two pivots is; roof: a distance within which k rows surely lie. reach: rows and outer radius of
    each cell; there are as many cells as pivots.
    """
    gaps = {d: distances(p, p) for d, p in known.items() if len(p) <= 1024}

    def run(batches):
        for batch in batches:
            for d, at, x in _by_length(batch.column(1)):
                used = np.array(sorted(c for (dims, c) in reach if dims == d), np.int64)
                if not len(used):
                    continue
                n = np.array([reach[d, c][0] for c in used.tolist()])
                hi = np.array([reach[d, c][1] for c in used.tolist()])
                for start in range(0, len(at), 64):
                    own = at[start : start + 64]
                    far = distances(x[start : start + 64], known[d])[:, np.maximum(used, 0)] if d in known else np.zeros((len(own), len(used)))
                    far[:, used == NO_CELL] = 0.0
                    roof = far + hi[None, :]
                    order = np.argsort(roof, axis=1)
                    enough = (np.cumsum(n[order], axis=1) >= k).argmax(1)
                    top = np.take_along_axis(roof, order, 1)[np.arange(len(own)), enough]
                    top[n.sum() < k] = np.inf
                    near = far.argmin(1)
                    plane = np.zeros_like(far)
                    if d in gaps and NO_CELL not in used:
                        gap = gaps[d][used[near]][:, used]
                        np.divide(far**2 - far[np.arange(len(own)), near][:, None] ** 2, 2 * gap, out=plane, where=gap > 0)
                    least = np.maximum(np.maximum(far - hi[None, :], plane), 0)
                    rows, columns = np.nonzero(least <= top[:, None] + SLACK)
                    take = pa.array(own[rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take), pa.array(np.full(len(rows), d, np.int32)), pa.array(used[columns].astype(np.int32)),
                            pa.array(columns == near[rows]), pa.array(far[rows, columns]), pa.array(plane[rows, columns]), pa.array(top[rows]),
                        ],
                        ["qid", "dims", "cell", "own", "away", "plane", "roof"],
                    )

    schema = _with(queries.select("qid"), dims="int", cell="int", own="boolean", away="double", plane="double", roof="double")
    return queries.select("qid", "vector").mapInArrow(run, schema)


def nearest_of(q: np.ndarray, x: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the k nearest rows of x to each of q; ties by order.

    The expanded form finds candidates, with room for its rounding; their distances are then taken from differences.
    """
    k = min(k, len(x))
    rough = (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :]
    bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
    # What rounding may take from the sum of two squares.
    room = 1e-6 + 1e-12 * ((q * q).sum(1) + (x * x).sum(1).max())
    out = []
    for start in range(0, len(q), 256):
        rows, columns = np.nonzero(rough[start : start + 256] <= (bound + room)[start : start + 256, None])
        rows += start
        exact = np.round(((q[rows] - x[columns]) ** 2).sum(1), 9)
        sort = np.lexsort((order[columns], exact, rows))
        rows, columns, exact = rows[sort], columns[sort], exact[sort]
        first = np.searchsorted(rows, np.arange(start, start + 256))
        keep = np.arange(len(rows)) - first[rows - start] < k
        out.append((rows[keep], columns[keep], exact[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _met(visits: DataFrame, asked: DataFrame, rows: DataFrame, k: int, queries: int) -> DataFrame:
    """qid, id, ord, distance: of each visit (qid, block) the k nearest rows of the block to the query's vector."""
    # A block's visitors are dealt over tasks of a bounded number of them; its rows go to each.
    n = visits.groupBy("block").agg(F.ceil(F.count("*") / queries).cast("int").alias("tasks"))
    visits = visits.join(asked, "qid")
    left = visits.join(n, "block").select("block", F.pmod(F.xxhash64("qid"), F.col("tasks")).cast("int").alias("task"), "qid", F.col("vector").alias("asked"))
    right = rows.join(n, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "id", "ord", "vector")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "ord")}
    qid = visits.schema["qid"].dataType.simpleString()

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], t) for c, t in zip(("qid", "id", "ord", "distance"), (asked.schema.field("qid").type, held.schema.field("id").type, held.schema.field("ord").type, pa.float64()), strict=True)})
        if not asked.num_rows or not held.num_rows:
            return empty
        q = np.asarray(asked["asked"].combine_chunks().flatten(), float).reshape(asked.num_rows, -1)
        x = np.asarray(held["vector"].combine_chunks().flatten(), float).reshape(held.num_rows, -1)
        at, columns, far = nearest_of(q, x, held["ord"].to_numpy(), k)
        return pa.table([asked["qid"].take(pa.array(at)), held["id"].take(pa.array(columns)), held["ord"].take(pa.array(columns)), pa.array(far)], names=empty.column_names)

    return left.groupBy("block", "task").cogroup(right.groupBy("block", "task")).applyInArrow(run, f"qid {qid}, id {kinds['id']}, ord {kinds['ord']}, distance double")


def visited(queries: DataFrame, corpus: DataFrame, k: int, work: Workspace, size: int = BLOCK, limit: int = PIVOTS) -> tuple[DataFrame, ...]:
    """Queries, rows by block, the list of blocks, first visits and their results, and the visits that are left: what topk does before its second meeting."""
    rows = _sound(corpus.select("id", "ord", F.col("vector").cast("array<double>").alias("vector")))
    known = pivots(rows, limit)
    rows, listed = blocks(assigned(rows, known), work, size)
    # A row for each cell, so for each pivot.
    reach = {(r["dims"], r["cell"]): (r["n"], r["hi"]) for r in listed.groupBy("dims", "cell").agg(F.sum("n").alias("n"), F.max("hi").alias("hi")).collect()}
    reach = {c: (n, math.inf if c[1] == NO_CELL else hi) for c, (n, hi) in reach.items()}
    asked = work.written(_sound(queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))), "asked")
    cells = work.written(_cells(asked, known, reach, k), "cells")
    away, lo, hi = F.col("away"), F.col("lo"), F.col("hi")
    ring = F.when(F.col("cell") == NO_CELL, 0.0).otherwise(F.greatest(away - hi, lo - away, F.col("plane"), F.lit(0.0)))
    pairs = cells.join(listed, ["dims", "cell"]).select("qid", "block", "n", "own", "roof", ring.alias("least")).where(F.col("least") <= F.col("roof") + SLACK)
    pairs = work.written(pairs, "pairs")
    # The nearest blocks of the own cell, until they hold k rows.
    before = F.sum("n").over(Window.partitionBy("qid").orderBy("least", "block").rowsBetween(Window.unboundedPreceding, -1))
    first = pairs.where("own").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    first = work.written(first.select("qid", "block"), "first")
    found = work.written(_met(first, asked, rows, k, QUERIES), "nearby")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance"))
    reached = found.withColumn("r", place).where(F.col("r") == k).select("qid", F.sqrt("distance").alias("reached"))
    left = pairs.join(reached, "qid", "left").where(F.col("reached").isNull() | (F.col("least") <= F.col("reached") + SLACK))
    left = left.select("qid", "block").join(first, ["qid", "block"], "left_anti")
    return asked, rows, listed, first, found, work.written(left, "left")


def topk(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT.k_sem, size: int = BLOCK, limit: int = PIVOTS) -> DataFrame:
    """qid, id, sem_rank, distance: the k nearest of corpus (id, ord, vector) to each of queries (qid, vector).

    Squared Euclidean distance in double precision; those that agree to 9 digits are ties, by corpus order. Vectors that are null, empty or hold null
    or non-finite elements, and those of another length, have no neighbours. qid and id are unique.
    """
    work = Workspace(corpus.sparkSession)
    asked, rows, _, _, found, left = visited(queries, corpus, k, work, size, limit)
    every = found.unionByName(_met(left, asked, rows, k, QUERIES))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "ord", "id"))
    ranked = every.withColumn("sem_rank", rank).where(F.col("sem_rank") <= k).select("qid", "id", "ord", "sem_rank", "distance")
    return result(ranked, "nearest", work)
