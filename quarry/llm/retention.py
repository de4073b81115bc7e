"""Cohort retention as a monoid over an RDD.

Clicks are packed into blocks of fixed-width rows, keyed by a salted place of their client, and dealt out once. Then:

* aggregateByKey folds the rows of a place into start pairs (the earliest purchase known in each state), which merge by minimum;
* the pairs of all places of a client are merged, get the client's segment, and go back to the places that hold its rows;
* rows and starts lie under one partitioner, and are zipped partition by partition: each row gets the period it belongs to in each state;
* reduceByKey merges facts of a user and period, then cells.

A client is salted by what it needs: one with more than 1/(4 P) of all clicks (P partitions; so there are 4 P of them at
most, whatever the input) is dealt over a number of places in proportion to its rows, by a hash of the row; every other client has one place. Only that
list is on the driver. All values are integers that are added or compared, so a task that runs again gives the same result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bounded

DAY = 86_400_000_000
#: Days in a cohort and in a period.
SPAN_DAYS = 3
CUT = "2024-03-01 00:00:00"
#: Later than any time: no start.
NEVER = np.iinfo(np.int64).max
#: Rows that a task gathers before it deals them out, so that blocks stay large however many places there are.
GATHERED = 1 << 20

ROW = np.dtype([("client", "<i8"), ("ts", "<i8"), ("cents", "<i8"), ("known", "?"), ("bought", "?")])
START = np.dtype([("client", "<i8"), ("s0", "<i8"), ("s1", "<i8")])
FACT = np.dtype([("client", "<i8"), ("state", "<i4"), ("period", "<i8"), ("cohort", "<i8"), ("moved", "?"), ("segment", "<i4"), ("cents", "<i8")])
CELL = np.dtype([("state", "<i4"), ("cohort", "<i8"), ("period", "<i8"), ("segment", "<i4"), *((c, "<i8") for c in ("users", "users_crc32", "moved", "cents"))])
RESULT = "state int, segment string, cohort bigint, period bigint, users bigint, users_crc32 bigint, moved bigint, cents bigint"


def facts_of_clicks(clicks: DataFrame) -> DataFrame:
    """client, ts (wall clock), cents, known (in state 0), bought, salt of every click with a time and a client; equal rows once.

    Text columns that only tell rows apart are compared by SHA-256, so less is shuffled.
    """
    used = ("click_id", "ts", "arrived_at", "client_id", "kind", "value")
    others = [c for c in clicks.columns if c not in used]
    whole = {c: isinstance(clicks.schema[c].dataType, T.StringType) for c in others}
    shown = [F.unhex(F.sha2(F.col(f"`{c}`"), 256)).alias(f"other{i}") if whole[c] else F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(others)]
    rows = clicks.where("ts is not null and client_id is not null").select(*used, *shown).distinct()
    h = F.crc32(F.col("click_id").cast("string"))
    late = F.when(h % 3 == 0, h % 100).otherwise(0).cast("int")
    arrives = F.col("arrived_at").cast("timestamp_ntz") + F.make_dt_interval(late)
    amount = F.floor(F.lit(100.0) * F.col("value") + F.lit(0.5)).cast("long")
    sound = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return rows.select(
        F.col("client_id").cast("long").alias("client"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(sound, amount).otherwise(F.lit(0)).alias("cents"),
        F.coalesce(arrives < F.lit(CUT).cast("timestamp_ntz"), F.lit(False)).alias("known"),
        F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("bought"),
        F.xxhash64("click_id", "ts", "value").alias("salt"),
    )


def heavy(clicks: DataFrame, places: int) -> dict[int, int]:
    """Places of each client with more than 1/(4 places) of all clicks: 4 * places clients at most, and 8 * places places."""
    n = clicks.count()
    counted = clicks.where("client_id is not null").groupBy("client_id").count().where(F.col("count") * 4 * places > n)
    return {int(r["client_id"]): min(places, -(-4 * places * r["count"] // n)) for r in counted.collect()}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads consecutive numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Places:
    """Where rows of a client lie: its own place, and for the heavy ones further places after it."""

    def __init__(self, places: int, hot: dict[int, int]):
        self.places = places
        self.clients = np.array(sorted(hot), np.int64)
        self.spread = np.array([hot[c] for c in sorted(hot)], np.int64)

    def own(self, client: np.ndarray) -> np.ndarray:
        return (mixed(client) % np.uint64(self.places)).astype(np.int64)

    def widths(self, client: np.ndarray) -> np.ndarray:
        """Number of places of each client."""
        out = np.ones(len(client), np.int64)
        if len(self.clients) and len(client):
            at = np.minimum(np.searchsorted(self.clients, client), len(self.clients) - 1)
            out = np.where(self.clients[at] == client, self.spread[at], out)
        return out

    def of(self, client: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (self.own(client) + (mixed(salt) % self.widths(client).astype(np.uint64)).astype(np.int64)) % self.places


def same(place: int) -> int:
    return place


def dealt(rows: np.ndarray, to: np.ndarray):
    """(place, its rows) of each place that has any."""
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for part, at in zip(np.split(rows, cuts), np.r_[0, cuts], strict=True):
        if len(part):
            yield int(to[at]), part


def grouped(rows: np.ndarray, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by keys, and where each group starts."""
    rows = rows[np.lexsort([rows[k] for k in reversed(keys)])]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        new[1:] |= rows[k][1:] != rows[k][:-1]
    return rows, np.flatnonzero(new)


# Start pairs: the monoid's element is a table sorted by client, with the minimum of each state.


def merged_starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rows, first = grouped(np.concatenate([a, b]), ["client"])
    out = rows[first]
    for state in ("s0", "s1"):
        out[state] = np.minimum.reduceat(rows[state], first) if len(first) else out[state]
    return out


def folded(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Start pairs with those of a block of rows merged in."""
    rows = rows[rows["bought"]]
    own = np.empty(len(rows), START)
    own["client"], own["s1"] = rows["client"], rows["ts"]
    own["s0"] = np.where(rows["known"], rows["ts"], NEVER)
    return merged_starts(starts, own)


class Pile:
    """Blocks that are merged when as many rows have come as are merged already, so that many small ones cost no more than a sort."""

    def __init__(self, merge, blocks: list):
        self.merge, self.blocks = merge, blocks

    def __add__(self, other: Pile) -> Pile:
        blocks = self.blocks + other.blocks
        if sum(len(b) for b in blocks[1:]) > len(blocks[0]):
            blocks = [self.merge(np.concatenate(blocks))]
        return Pile(self.merge, blocks)

    def whole(self) -> np.ndarray:
        return self.merge(np.concatenate(self.blocks))


def merged_facts(rows: np.ndarray) -> np.ndarray:
    rows, first = grouped(rows, ["client", "state", "period"])
    out = rows[first]
    out["cents"] = np.add.reduceat(rows["cents"], first) if len(first) else out["cents"]
    return out


def periods(rows: np.ndarray, starts: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Facts of a partition's rows; a segment is its number in names. starts: client, s0, s1, segment, sorted by client."""
    at = np.searchsorted(starts["client"].to_numpy(), rows["client"])
    at = np.minimum(at, max(0, len(starts) - 1))
    found = starts["client"].to_numpy()[at] == rows["client"] if len(starts) else np.zeros(len(rows), bool)
    rows, at = rows[found], at[found]
    s0, s1 = (starts[c].to_numpy()[at] for c in ("s0", "s1"))
    segment = pd.Index(names).get_indexer(starts["segment"])[at] if len(starts) else np.zeros(0, int)
    cohorts = [s // DAY // SPAN_DAYS for s in (s0, s1)]
    moved = (s0 != NEVER) & (s1 != NEVER) & (cohorts[0] != cohorts[1])
    out = []
    for state, start in ((0, s0), (1, s1)):
        keep = (start != NEVER) & (rows["ts"] >= start)
        keep &= rows["known"] if state == 0 else True
        fact = np.empty(int(keep.sum()), FACT)
        fact["client"], fact["state"], fact["cents"] = rows["client"][keep], state, rows["cents"][keep]
        fact["period"] = (rows["ts"][keep] - start[keep]) // (SPAN_DAYS * DAY)
        fact["cohort"], fact["moved"], fact["segment"] = cohorts[state][keep], moved[keep], segment[keep]
        out.append(fact)
    return merged_facts(np.concatenate(out))


def zip_partitions(left: RDD, right: RDD, run) -> RDD:
    """run(left's elements, right's elements) for each pair of partitions of two RDDs under one partitioner.

    Elements are blocks, so a partition's list is short.
    """
    return left.glom().zip(right.glom()).flatMap(lambda pair: run(*pair))


# Segments are texts: blocks that leave a task carry the names that their numbers stand for.


def named(rows: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[str]]:
    """A block with the names that occur in it only."""
    used, number = np.unique(rows["segment"], return_inverse=True)
    rows = rows.copy()
    rows["segment"] = number
    return rows, [names[i] for i in used]


def joined(blocks: list[tuple[np.ndarray, list[str]]], kind: np.dtype) -> tuple[np.ndarray, list[str]]:
    """Several such blocks as one."""
    place: dict[str, int] = {}
    out = [np.empty(0, kind)]
    for rows, names in blocks:
        numbers = np.array([place.setdefault(n, len(place)) for n in names], np.int32)
        rows = rows.copy()
        rows["segment"] = numbers[rows["segment"]] if len(rows) else rows["segment"]
        out.append(rows)
    return np.concatenate(out), list(place)


class Named:
    """A pile of blocks with names: facts, or cells."""

    def __init__(self, merge, kind: np.dtype, blocks: list):
        self.merge, self.kind, self.blocks = merge, kind, blocks

    def __add__(self, other: Named) -> Named:
        blocks = self.blocks + other.blocks
        if sum(len(b[0]) for b in blocks[1:]) > len(blocks[0][0]):
            rows, names = joined(blocks, self.kind)
            blocks = [(self.merge(rows), names)]
        return Named(self.merge, self.kind, blocks)

    def whole(self) -> tuple[np.ndarray, list[str]]:
        rows, names = joined(self.blocks, self.kind)
        return self.merge(rows), names


def cells_of(facts: np.ndarray) -> np.ndarray:
    """Cells of facts that are whole: each is one user in one period."""
    rows = np.empty(len(facts), CELL)
    for c in ("state", "cohort", "period", "segment", "cents"):
        rows[c] = facts[c]
    clients, number = np.unique(facts["client"], return_inverse=True)
    crc = np.array([zlib.crc32(str(c).encode()) for c in clients.tolist()], np.int64)
    rows["users"], rows["moved"] = 1, facts["moved"]
    rows["users_crc32"] = crc[number] if len(clients) else 0
    return merged_cells(rows)


def merged_cells(rows: np.ndarray) -> np.ndarray:
    rows, first = grouped(rows, ["state", "segment", "cohort", "period"])
    out = rows[first]
    for c in ("users", "users_crc32", "moved", "cents"):
        out[c] = np.add.reduceat(rows[c], first) if len(first) else out[c]
    return out


def _blocks(rows: DataFrame, at: Places) -> RDD:
    """(place, block of ROW) of clicks."""

    def deal(held):
        salt = np.concatenate([s for _, s in held])
        rows = np.concatenate([r for r, _ in held])
        for place, part in dealt(rows, at.of(rows["client"], salt)):
            yield place, part.tobytes()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            block = np.empty(batch.num_rows, ROW)
            for name in ROW.names:
                column = batch.column(batch.schema.get_field_index(name))
                # Times as microseconds since 1970.
                column = column.cast(pa.timestamp("us")).cast(pa.int64()) if name == "ts" else column
                block[name] = column.to_numpy(zero_copy_only=False)
            held.append((block, batch.column(batch.schema.get_field_index("salt")).to_numpy()))
            n += len(block)
            if n >= GATHERED:
                yield _packed(deal(held))
                held, n = [], 0
        if n:
            yield _packed(deal(held))

    packed = bounded(rows).mapInArrow(run, "place int, block binary").rdd
    return packed.map(lambda r: (r[0], np.frombuffer(r[1], ROW)))


def _packed(blocks) -> pa.RecordBatch:
    places, data = zip(*blocks, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(data, pa.binary())], ["place", "block"])


def _segments(clients: DataFrame, at: Places) -> RDD:
    """(own place, client and segment) of clients; of several rows of one the smallest city, null if there is none."""

    def run(batches):
        for batch in batches:
            client, city = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            own = at.own(client)
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            parts = [p for p in np.split(order, cuts) if len(p)]
            if parts:
                ipc = [pa.record_batch([pa.array(client[p]), pa.array(city[p], pa.string())], ["client", "segment"]).serialize() for p in parts]
                yield _packed((int(own[p[0]]), x.to_pybytes()) for p, x in zip(parts, ipc, strict=True))

    rows = clients.where("client_id is not null").groupBy(F.col("client_id").cast("long").alias("client"))
    rows = rows.agg(F.coalesce(F.min(F.col("city").cast("string")), F.lit("")).alias("segment"))
    return bounded(rows).mapInArrow(run, "place int, block binary").rdd.map(tuple)


def _known_segments(blocks: list) -> dict:
    schema = pa.schema([("client", pa.int64()), ("segment", pa.string())])
    out: dict = {}
    for block in blocks:
        batch = pa.ipc.read_record_batch(pa.py_buffer(block), schema)
        out.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    return out


def matrix(clicks: DataFrame, clients: DataFrame, places: int | None = None) -> DataFrame:
    """The cells of RESULT that have a user, in both states of knowledge.

    clicks: click_id, ts, arrived_at, client_id, kind, value, and any further columns, which tell rows apart;
    clients: client_id, city. State 0 knows the clicks that arrive before CUT, state 1 all. A click whose crc32 of its id
    (in decimal) 3 divides arrives that many days, modulo 100, after arrived_at. A null arrived_at is known in state 1 only; a null click_id is not delayed; a
    value that is null, NaN or infinite is 0 cents; a null kind is no purchase. A client of several rows has the smallest of its cities, and one of
    none the empty segment. Empty tables give no cells, or cells of the empty segment. places is the number of partitions
    (spark.sql.shuffle.partitions).
    """
    spark = clicks.sparkSession
    places = places or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = Places(places, heavy(clicks, places))
    rows = _blocks(facts_of_clicks(clicks), at).partitionBy(places, same)

    # Narrow: rows lie by place already.
    pairs = rows.aggregateByKey(np.empty(0, START), folded, merged_starts, places, same)

    def to_owner(item):
        place, starts = item
        for owner, part in dealt(starts, at.own(starts["client"])):
            yield owner, Pile(_merge_all_starts, [part])

    owned = pairs.flatMap(to_owner).reduceByKey(lambda a, b: a + b, places, same)

    def to_rows(piles: list, cities: list):
        """Each start to the places of its client, which the list of heavy clients tells."""
        known = _known_segments([b for _, b in cities]) if piles else {}
        for _, pile in piles:
            starts = pile.whole()
            wide = at.widths(starts["client"])
            again = np.repeat(np.arange(len(starts)), wide)
            turn = np.arange(len(again)) - np.repeat(np.cumsum(wide) - wide, wide)
            to = (at.own(starts["client"])[again] + turn) % at.places
            for place, part in dealt(again, to):
                own = starts[part]
                yield place, (own, [known.get(c, "") for c in own["client"].tolist()])

    cities = _segments(clients, at).partitionBy(places, same)
    applied = zip_partitions(owned, cities, to_rows).partitionBy(places, same)

    def to_facts(blocks: list, starts: list):
        if not blocks or not starts:
            return
        table = pd.DataFrame(np.concatenate([s for _, (s, _) in starts]))
        table["segment"] = [x for _, (_, names) in starts for x in names]
        table = table.sort_values("client")
        names = sorted(set(table["segment"]))
        facts = periods(np.concatenate([b for _, b in blocks]), table, names)
        # Facts of a client with one place are whole here; those of the others meet by client, state and period.
        key = mixed(facts["client"] * 1_000_003 + facts["period"] * 2 + facts["state"]) % np.uint64(at.places)
        to = np.where(at.widths(facts["client"]) > 1, key.astype(np.int64), at.own(facts["client"]))
        for place, part in dealt(facts, to):
            yield place, Named(merged_facts, FACT, [named(part, names)])

    facts = zip_partitions(rows, applied, to_facts).reduceByKey(lambda a, b: a + b, places, same)

    def to_cells(item):
        rows, names = item[1].whole()
        rows = cells_of(rows)
        crc = np.array([zlib.crc32(n.encode()) for n in names], np.int64)
        with np.errstate(over="ignore"):
            mix = (crc[rows["segment"]] * 1_000_003 + rows["cohort"]) * 1_000_003 + rows["period"] * 2 + rows["state"]
        for place, part in dealt(rows, (mixed(mix) % np.uint64(at.places)).astype(np.int64)):
            yield place, Named(merged_cells, CELL, [named(part, names)])

    cells = facts.flatMap(to_cells).reduceByKey(lambda a, b: a + b, places, same)

    def shown(item):
        rows, names = item[1].whole()
        columns = [pa.array(rows["state"].copy()), pa.array([names[i] for i in rows["segment"].tolist()], pa.string())]
        columns += [pa.array(rows[c].copy()) for c in ("cohort", "period", "users", "users_crc32", "moved", "cents")]
        return (pa.record_batch(columns, CELL_COLUMNS).serialize().to_pybytes(),)

    packed = spark.createDataFrame(cells.map(shown), T.StructType([T.StructField("block", T.BinaryType())]), verifySchema=False)

    def unpacked(batches):
        for batch in batches:
            for block in batch.column(0):
                yield pa.ipc.read_record_batch(pa.py_buffer(block.as_py()), CELL_SCHEMA)

    return packed.mapInArrow(unpacked, RESULT)


CELL_COLUMNS = ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
CELL_SCHEMA = pa.schema([("state", pa.int32()), ("segment", pa.string()), *((c, pa.int64()) for c in CELL_COLUMNS[2:])])


def _merge_all_starts(rows: np.ndarray) -> np.ndarray:
    return merged_starts(rows[:0], rows)
