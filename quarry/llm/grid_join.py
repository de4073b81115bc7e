"""Epsilon grid order join of embeddings: all pairs of a label with a cosine of SIMILAR or more.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the join is one within that distance, eps. Vectors are
laid out by grid cells of width eps on leading principal axes and cut, in that order, into
blocks of bounded size with their bounding boxes. Two blocks are compared only if their cells
touch and their boxes are not further apart than eps; a comparison halves both
sequences again and again, skipping halves that are provably distant, and ends in
small products of matrices. The axes come from a bounded sample and only decide what is skipped: a distance
along any orthonormal axes is never more than the whole distance, so no link is lost.

Equal vectors form a class with a count. A block pair returns each class's number of links and
a spanning forest of its links, never the links of a group.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, and
one without a label, links with nothing and is its own component. Vectors of different lengths
never link. A cosine within 1e-9 of the threshold is decided by exactly rounded sums. Rows are judged one by
one: repeated rows link with each other; a null id never names a component. An empty table
gives an empty one. Further columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, ddl, dropped, written
from quarry.llm.components import components

SIMILAR = 0.98
#: Vectors that the axes are fitted on, axes with boxes, axes whose cells key the blocks.
SAMPLE, AXES, KEYS = 4096, 6, 3
#: Vectors in a block, and in a sequence that is compared without further halving.
BLOCK, LEAF = 512, 64
SLACK = 1e-9


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, or None if it can't link."""
    out = []
    for values in column.to_pylist():
        x = None
        if values and None not in values:
            x = np.asarray(values, np.float64)
            x = x if np.isfinite(x).all() and x.any() else None
        out.append(x)
    return out


def _prepared(rows: DataFrame) -> DataFrame:
    """id, label, key of the vector's class (null if it links with nothing), its doubles as bytes."""

    def run(batches):
        for part in batches:
            keys, data = [], []
            for label, x in zip(part.column(1).to_pylist(), _rows(part.column(2)), strict=True):
                raw = None if x is None or label is None else (x + 0.0).tobytes()
                keys.append(None if raw is None else xxhash.xxh3_128_digest(repr(label).encode() + b"\0" + raw))
                data.append(raw)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                ["id", "label", "key", "vector"],
            )

    return rows.mapInArrow(run, f"id {ddl(rows, 'id')}, label {ddl(rows, 'label')}, key binary, vector binary")


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Axes by number of dimensions, most of the spread first, from a bounded sample of classes."""
    rows = classes.select("key", "vector").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for _, vector in rows:
        by.setdefault(len(vector) // 8, []).append(bytes(vector))
    out = {}
    for dims, data in by.items():
        x = _unit(data)
        _, axes = np.linalg.eigh(np.cov(x, rowvar=False).reshape(dims, dims) if len(x) > 1 else np.eye(dims))
        out[dims] = np.ascontiguousarray(axes[:, ::-1][:, :AXES])
    return out


def _placed(unit: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros((len(unit), AXES))
    if unit.shape[1] in axes:
        on = unit @ axes[unit.shape[1]]
        out[:, : on.shape[1]] = on
    return out


def _blocks(classes: DataFrame, axes: dict, eps: float) -> DataFrame:
    """Blocks of neighbouring vectors: id, side (label and dims), cells, box, members."""

    def cells(batches):
        for part in batches:
            for dims in sorted({len(v) // 8 for v in part.column(3).to_pylist()}):
                own = part.filter(pa.array([len(v) // 8 == dims for v in part.column(3).to_pylist()]))
                at = np.floor(_placed(_unit(own.column(3).to_pylist()), axes) / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array([dims] * own.num_rows, pa.int32()), *(pa.array(at[:, i]) for i in range(KEYS + 1))],
                    ["key", "label", "n", "vector", "dims", *(f"c{i}" for i in range(KEYS + 1))],
                )

    order = ["side", *(f"c{i}" for i in range(KEYS + 1)), "key"]
    named = ", ".join(f"c{i} int" for i in range(KEYS + 1))
    kind = ddl(classes, "label")
    rows = classes.select("key", "label", "n", "vector").mapInArrow(
        cells, f"key binary, label {kind}, n bigint, vector binary, dims int, {named}"
    )
    rows = rows.select(F.xxhash64("label", "dims").alias("side"), *(f"c{i}" for i in range(KEYS + 1)), "key", "n", "vector")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        group, held = None, []

        def flush():
            unit = _placed(_unit([h[1] for h in held]), axes)
            return {
                "id": held[0][0],
                "side": group[0],
                **{f"c{i}": group[1 + i] for i in range(KEYS)},
                "low": unit.min(0).tolist(),
                "high": unit.max(0).tolist(),
                "keys": b"".join(h[0] for h in held),
                "counts": np.array([h[2] for h in held], np.int64).tobytes(),
                "vectors": b"".join(h[1] for h in held),
            }

        for batch in batches:
            names = batch.schema.names
            out = []
            columns = [batch.column(names.index(c)).to_pylist() for c in ("side", *(f"c{i}" for i in range(KEYS)), "key", "vector", "n")]
            for row in zip(*columns, strict=True):
                own = row[: 1 + KEYS]
                if held and (own != group or len(held) >= BLOCK):
                    out.append(flush())
                    held = []
                group = own
                held.append(row[1 + KEYS :])
            if out:
                yield pa.RecordBatch.from_pylist(out, _schema)
        if held:
            yield pa.RecordBatch.from_pylist([flush()], _schema)

    box = pa.list_(pa.float64())
    _schema = pa.schema(
        [("id", pa.binary()), ("side", pa.int64()), *((f"c{i}", pa.int32()) for i in range(KEYS)), ("low", box), ("high", box),
         ("keys", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())]
    )
    keyed = ", ".join(f"c{i} int" for i in range(KEYS))
    return rows.mapInArrow(
        cut, f"id binary, side bigint, {keyed}, low array<double>, high array<double>, keys binary, counts binary, vectors binary"
    )


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """a, b: blocks of a side, a not after b, whose cells touch and whose boxes are within eps."""
    cells = [f"c{i}" for i in range(KEYS)]
    meta = blocks.select("id", "side", *cells, "low", "high")
    left = meta.select(F.col("id").alias("a"), "side", *cells, F.col("low").alias("la"), F.col("high").alias("ha"))
    right = meta.select(F.col("id").alias("b"), "side", *cells, F.col("low").alias("lb"), F.col("high").alias("hb"))
    for c in cells:
        right = right.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    gap = lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(F.lit(0.0), p - q))
    apart = F.aggregate(
        F.zip_with(gap(F.col("la"), F.col("hb")), gap(F.col("lb"), F.col("ha")), lambda p, q: F.greatest(p, q) * F.greatest(p, q)),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    near = left.join(right, ["side", *cells]).where((F.col("a") <= F.col("b")) & (apart <= (eps + SLACK) ** 2))
    return near.select("a", "b")


def _decided(x: np.ndarray, y: np.ndarray, similar: float) -> bool:
    dot = math.fsum((x * y).tolist())
    return dot >= similar * math.sqrt(math.fsum((x * x).tolist())) * math.sqrt(math.fsum((y * y).tolist()))


class _Join:
    """The recursive join of two sequences: link counts by member, and a spanning forest."""

    def __init__(self, a, b, same: bool, similar: float, eps: float):
        (self.ua, self.pa, self.na, self.ra), (self.ub, self.pb, self.nb, self.rb) = a, b
        self.same, self.similar, self.eps = same, similar, eps
        self.ca, self.cb = np.zeros(len(self.na), np.int64), np.zeros(len(self.nb), np.int64)
        self.parent: dict = {}
        self.forest: list[tuple[int, int]] = []
        self.visit(0, len(self.na), 0, len(self.nb))

    def visit(self, a0, a1, b0, b1):
        if self.same and b1 <= a0:
            return  # the mirror image of what is visited elsewhere
        gap = np.maximum(self.pa[a0:a1].min(0) - self.pb[b0:b1].max(0), self.pb[b0:b1].min(0) - self.pa[a0:a1].max(0))
        if (np.maximum(gap, 0) ** 2).sum() > (self.eps + SLACK) ** 2:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self.leaf(a0, a1, b0, b1)
            return
        am = [(a0, a1)] if a1 - a0 <= LEAF else [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)]
        bm = [(b0, b1)] if b1 - b0 <= LEAF else [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)]
        for x in am:
            for y in bm:
                self.visit(*x, *y)

    def leaf(self, a0, a1, b0, b1):
        cosine = self.ua[a0:a1] @ self.ub[b0:b1].T
        linked = cosine >= self.similar
        for i, j in zip(*np.nonzero(np.abs(cosine - self.similar) < SLACK), strict=True):
            linked[i, j] = _decided(self.ra[a0 + i], self.rb[b0 + j], self.similar)
        if self.same:
            linked &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not linked.any():
            return
        self.ca[a0:a1] += linked @ self.nb[b0:b1]
        other = linked.T @ self.na[a0:a1]
        if self.same:
            self.ca[b0:b1] += other
        else:
            self.cb[b0:b1] += other
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            u, v = a0 + i, (b0 + j) if self.same else -1 - (b0 + j)
            x, y = self.find(u), self.find(v)
            if x != y:
                self.parent[x] = y
                self.forest.append((u, v))

    def find(self, x):
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x


def _compared(pairs: DataFrame, blocks: DataFrame, axes: dict, similar: float, eps: float) -> DataFrame:
    """u, v, n: either a class with links found, or (n = 0) a link of the spanning forest."""
    side = lambda s: blocks.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("keys", "counts", "vectors")))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.select("a", "b", *(f"{c}_{s}" for s in "ab" for c in ("keys", "counts", "vectors")))

    def loaded(keys, counts, vectors):
        n = np.frombuffer(counts, np.int64)
        raw = np.frombuffer(vectors, np.float64).reshape(len(n), -1)
        unit = _unit([vectors[i : i + raw.shape[1] * 8] for i in range(0, len(vectors), raw.shape[1] * 8)])
        return [keys[i : i + 16] for i in range(0, len(keys), 16)], (unit, _placed(unit, axes), n, raw)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, *rest = (batch.column(i)[r].as_py() for i in range(8))
                ka, left = loaded(*rest[:3])
                kb, right = (ka, left) if a == b else loaded(*rest[3:])
                found = _Join(left, right, a == b, similar, eps)
                u, v, n = [], [], []
                for keys, counts in ((ka, found.ca), (kb, found.cb)):
                    for i in np.flatnonzero(counts).tolist():
                        u.append(keys[i])
                        v.append(None)
                        n.append(int(counts[i]))
                for x, y in found.forest:
                    u.append(ka[x] if x >= 0 else kb[-1 - x])
                    v.append(ka[y] if y >= 0 else kb[-1 - y])
                    n.append(0)
                if u:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], ["u", "v", "n"]
                    )

    return rows.mapInArrow(run, "u binary, v binary, n bigint")


def similar_vectors(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", similar: float = SIMILAR
) -> DataFrame:
    """A row per vector: id, n_links (other rows linked), component_id (smallest id reachable), kept (the id is the component's)."""
    eps = math.sqrt(2 - 2 * similar)
    rows = bounded(vectors).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = written(_prepared(rows), "vectors")
    classes = rows.where(F.col("key").isNotNull()).groupBy("key")
    classes = classes.agg(
        F.min("label").alias("label"), F.min("vector").alias("vector"), F.count("*").alias("n"), F.min("id").alias("least")
    )
    classes = written(classes, "classes")
    axes = principal_axes(classes)
    blocks = written(_blocks(classes, axes, eps), "blocks")
    pairs = written(_pairs(blocks, eps), "pairs")
    found = written(_compared(pairs, blocks, axes, similar, eps), "found")
    dropped(pairs)
    dropped(blocks)
    counts = found.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("links"))
    roots = components(found.where("v is not null"))
    members = classes.select("key", "n", "least").join(roots.select(F.col("vertex").alias("key"), "root"), "key", "left")
    members = members.select("key", "n", "least", F.coalesce("root", "key").alias("root")).join(counts, "key", "left")
    members = written(members, "members")
    least = written(members.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = written(members.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"), "known")
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
