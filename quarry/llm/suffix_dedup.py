"""Repeated-passage removal by a depth-limited radix sort of suffixes.

The aim is every string of `length` units that starts at two places at least; a unit is a byte or a word. Suffixes are
told apart by most-significant-digit passes that go no deeper than `length` units, and a pass keeps only suffixes whose
digits so far are shared; the groups left by the last pass are the repeated windows.

A window is represented by one suffix in it: the one whose leading gram of (length + 1) // 2 units has the smallest
hash in the window, the leftmost of equals. That choice depends on the window's units alone, so equal windows choose
alike, and about one suffix in a hundred bytes is ever chosen and sorted. The digits of a chosen suffix:
1. its leading gram. Suffixes alone with it stand in no repeated window;
2. all units of all windows that can choose it (its context). Where two are equal, all of that is covered;
3. for contexts that differ, the units that a zone of neighbouring windows share, then
   those that any of them holds: alone with the first, none of them repeats; equal in the second, all of them do;
4. for zones that this does not decide the same for their parts, until a part is a single window.
A digit is a block of units, compared by a 64-bit hash within the group that the digit before it left, so equal
digits agree in two such hashes or more. So the passes find equal groups; an order of unequal groups, which nothing
here needs, is not made: this is the method's grouping, on chosen suffixes, and not its whole order.

Rows are numbered first and written; the number, not the id, is what all passes know a row by. Equal
suffixes of a slice of text (PIECE_BYTES) are one row with a list of places before anything is shuffled, so
a passage that a third of all rows share costs a row for each slice and not for each document. Nothing is
gathered but the places of one slice or row.

Defined cases: null and empty texts, and texts shorter than `length` units, keep all bytes. Each
row is a document: repeated rows repeat each other's windows, whatever their ids. Ids, null or not, are only carried.
An empty table gives an empty one. Texts of any length are taken whole, in overlapping slices; further columns are not looked at.
Words are runs without ASCII white space, and what stands between them is not compared.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bounded, buffers, ddl, dropped, freed, pieces, written

LENGTH = 400
#: Zones that the windows of a suffix are dealt to, and parts of a zone in each further pass.
ZONES, PARTS = 8, 5
#: Positions that fit the low bits of a sort key.
_BITS = 20
_SLICE = 1 << _BITS
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _kept or len(_kept[base]) < n:
        steps = np.full(max(n, _SLICE + 1), base, np.uint64)
        steps[0] = 1
        _kept[base] = np.cumprod(steps, dtype=np.uint64)
    return _kept[base][:n]


def chosen(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Sorted places of the suffixes that some window of `length` bytes within a text chooses."""
    gram = (length + 1) // 2
    across = length - gram + 1
    out = []
    for at in range(0, max(1, len(raw)), _SLICE - length):
        data = raw[at : at + _SLICE]
        n = len(data)
        if n < length:
            break
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64, out=total[1:])
        m = n - gram + 1
        key = (total[gram:] - total[:m]) * _powers(_INVERSE, m)
        del total
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        key &= np.uint64(~(_SLICE - 1) & (2**64 - 1))
        key |= np.arange(m, dtype=np.uint64)
        # The least key of each window: from the ends of blocks of its size.
        full = -(-m // across) * across
        blocks = np.full(full, 2**64 - 1, np.uint64)
        blocks[:m] = key
        blocks = blocks.reshape(-1, across)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
        windows = n - length + 1
        least = np.minimum(back[:windows], ahead[across - 1 : across - 1 + windows])
        whole = np.ones(windows, bool)
        edges = offsets[1:-1] - at
        for edge in edges[(edges > 0) & (edges < n)].tolist():
            whole[max(0, edge - length + 1) : edge] = False
        found = (least[whole] & np.uint64(_SLICE - 1)).astype(np.int64)
        if len(found):
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] + at)
        if at + _SLICE >= len(raw):
            break
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of all texts, and the first word of each text."""
    black = ~_WHITE[raw]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = black[edges]
    last[edges - 1] = black[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, which only decides what is chosen."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = int(np.searchsorted(ends, base + _SLICE, side="right"))
        if stop <= at:
            out[at] = xxhash.xxh3_64_intdigest(raw[base : ends[at]].tobytes())
            at += 1
            continue
        data = raw[base : ends[stop - 1]]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64, out=total[1:])
        a, b = starts[at:stop] - base, ends[at:stop] - base
        key = (total[b] - total[a]) * _powers(_INVERSE, len(data))[a]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        out[at:stop] = key ^ (key >> np.uint64(32))
        at = stop
    return out



class _Units:
    """Texts as units: bytes, or words joined by single spaces. first: the first unit of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, by_words: bool):
        self.by_words, self.offsets = by_words, offsets
        if not by_words:
            self.first, self.keys, self.data = offsets, raw, raw.tobytes()
            return
        self.starts, self.ends, self.first = _words(raw, offsets)
        self.keys = _word_keys(raw, self.starts, self.ends)
        sizes = self.ends - self.starts
        self.to = np.cumsum(sizes + 1) - 1
        self.at = self.to - sizes
        data = np.full(int(self.to[-1]) + 1 if len(self.to) else 0, 0x20, np.uint8)
        black = raw[~_WHITE[raw]]
        data[np.arange(len(black)) + np.repeat(np.arange(len(sizes)), sizes)] = black
        self.data = data.tobytes()

    def digests(self, low: np.ndarray, high: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the units low to high (not included)."""
        a, b = (self.at[low], self.to[high - 1]) if self.by_words else (low, high)
        data, digest = self.data, xxhash.xxh3_64_intdigest
        if seeds is None:
            found = [digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        else:
            found = [digest(data[x:y], seed=z) for x, y, z in zip(a.tolist(), b.tolist(), seeds.tolist(), strict=True)]
        return np.array(found, np.uint64)

    def places(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end, within their text, of the units low to high (not included)."""
        a, b = (self.starts[low], self.ends[high - 1]) if self.by_words else (low, high)
        return a - self.offsets[row], b - self.offsets[row]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _seeds(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint64)


def _listed(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs: the row of each struct, and its fields."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    rows = column.flatten()
    fields = [rows.field(i).to_numpy(zero_copy_only=False) for i in range(rows.type.num_fields)]
    return np.repeat(np.arange(len(column)), sizes), fields


#: Numbers of a place in a list of places, each counted from the one that it follows, so that they are small and alike: row (from the
#: piece), unit, first byte (from the unit's number) and bytes (from there) of what is covered if the context stands elsewhere.
PLACE = 4


class Rule(NamedTuple):
    """Strings of so many units, which are bytes or words."""

    length: int
    by_words: bool = False

    @property
    def gram(self) -> int:
        return (self.length + 1) // 2

    @property
    def spread(self) -> int:
        """The furthest that a window starts before its suffix."""
        return self.length - self.gram

    @property
    def widths(self) -> list[int]:
        """Windows in a zone, for one pass after the other down to a single window."""
        out = [self.spread // ZONES + 1]
        while out[-1] > 1:
            out.append(-(-out[-1] // PARTS))
        return out


def _suffixes(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """piece, rule, gram, context (digits 1 and 2), places: the chosen suffixes, those of a slice with equal digits together."""

    def run(batches):
        for part in pieces(batches, "text"):
            number = part.column(0).to_numpy()
            raw, offsets = buffers(part.column(1))
            for r, rule in enumerate(rules):
                units = _Units(raw, offsets, rule.by_words)
                at = chosen(units.keys, units.first, rule.length)
                if not len(at):
                    continue
                row = np.searchsorted(units.first, at, side="right") - 1
                low = np.maximum(units.first[row], at - rule.spread)
                high = np.minimum(units.first[row + 1], at + rule.length)
                one, two = units.digests(at, at + rule.gram), units.digests(low, high, at - low)
                a, b = units.places(row, low, high)
                order = np.lexsort((two, one))
                one, two = one[order], two[order]
                head = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
                unit = at - units.first[row]
                fields = [number[row[order]] - number[0], unit[order], (a - unit)[order], (b - a)[order]]
                ends = np.append(head, len(order)) * PLACE
                places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.stack(fields, 1).ravel().astype(np.int64)))
                same = [pa.array(np.full(len(head), number[0])), pa.array(np.full(len(head), r, np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*same, _signed(one[head]), _signed(two[head]), places], ["piece", "rule", "gram", "context", "places"]
                )

    return rows.select("row", "text").mapInArrow(run, "piece bigint, rule int, gram bigint, context bigint, places array<bigint>")


def _within(units: _Units, at: np.ndarray, row: np.ndarray, near, far, length: int) -> np.ndarray:
    """Whether the windows that start near to far units before `at` may lie within its text."""
    return (at - near >= units.first[row]) & (at - far + length <= units.first[row + 1])


def _units_of(part, rules: list[Rule]):
    """For each rule with places: its number and itself, units, and of each place its text, unit and fields but rule and pos."""
    raw, offsets = buffers(part.column(1))
    row, (rule, pos, *fields) = _listed(part.column(2))
    for r in np.unique(rule).tolist():
        own = np.flatnonzero(rule == r)
        units = _Units(raw, offsets, rules[r].by_words)
        yield r, rules[r], units, row[own], units.first[row[own]] + pos[own], [pos[own], *(f[own] for f in fields)]


def _zones(rows: DataFrame, rules: list[Rule], level: int) -> DataFrame:
    """piece, rule, row, pos, zone, c, the bytes low to high of its windows, with digits core (shared by them) and hull (all they hold).

    At level 0 these are the zones of a suffix, at a further level the parts of a zone; at the last, single windows."""
    names = ["piece", "rule", "row", "pos", "zone", "c", "low", "high", "core", "hull"]

    def run(batches):
        for part in pieces(batches, "text"):
            number = part.column(0).to_numpy()
            for r, rule, units, row, at, (pos, piece, outer, seed, times) in _units_of(part, rules):
                size, width = rule.widths[level - 1] if level else rule.spread + 1, rule.widths[level]
                for step in range(0, size, width):
                    zone = outer + step
                    last = np.minimum(np.minimum(zone + width, outer + size) - 1, rule.spread)  # windows start zone to last units before the suffix
                    take = np.flatnonzero((zone <= rule.spread) & _within(units, at, row, zone, last, rule.length))
                    if not len(take):
                        continue
                    own, p, near, far = row[take], at[take], zone[take], last[take]
                    low = np.maximum(units.first[own], p - far)
                    high = np.minimum(units.first[own + 1], p - near + rule.length)
                    core = units.digests(p - near, p - far + rule.length, _seeds(seed[take]) ^ near.astype(np.uint64))
                    hull = units.digests(low, high, p - low)
                    columns = [piece[take], np.full(len(take), r), number[own], pos[take], near, times[take], *units.places(own, low, high)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), _signed(core), _signed(hull)], names)

    return rows.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def _sought(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, text, places: the texts of wanted rows, with what is wanted of them."""
    places = wanted.groupBy("row").agg(F.collect_list(F.struct("rule", "pos", "piece", "zone", "seed", "c")).alias("places"))
    # One plan at every size: what small tables show holds for large ones.
    return rows.select("row", "text").join(places.hint("merge"), "row").select("row", "text", "places")


def _marks(found: DataFrame) -> DataFrame:
    return found.select("piece", F.col("rule").cast("int"), F.array(F.expr("row - piece"), F.lit(0), "low", F.expr("high - low")).alias("places"))


def _step(df: DataFrame, tag: str) -> DataFrame:
    """Written, and the shuffle files of the step let go: these tables are large beside the texts."""
    out = written(df, tag)
    freed(out.sparkSession)
    return out


def repeated(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """piece, rule, places of intervals of bytes that together cover all windows of rows (row, text) that a rule finds
    repeated; they may overlap. All places of a row have one piece."""
    suffixes = _step(_suffixes(rows, rules), "suffixes")

    # Digit 1: only grams that occur twice go on. Different contexts mark the gram for further digits. One rule after the other,
    # so that the shuffle files of one are gone before the next one's are made.
    grown = []
    for r in range(len(rules)):
        own = suffixes.where(F.col("rule") == r)
        grams = own.groupBy("rule", "gram").agg(F.sum(F.size("places") / PLACE).alias("n"), (F.min("context") != F.max("context")).alias("mixed"))
        grams = _step(grams.where("n > 1").select("rule", "gram", "mixed"), "grams")
        grown.append(_step(own.join(grams, ["rule", "gram"]), "shared"))
        dropped(grams)
    dropped(suffixes)
    shared = reduce(DataFrame.unionByName, grown)

    # Digit 2: equal contexts are covered; one of each goes on where contexts differ.
    one = F.struct("piece", (F.col("piece") + F.element_at("places", 1)).alias("row"), F.element_at("places", 2).alias("pos"))
    contexts = shared.groupBy("rule", "gram", "context", "mixed").agg(F.sum(F.size("places") / PLACE).cast("long").alias("c"), F.min(one).alias("one"))
    contexts = _step(contexts.where("c > 1 or mixed"), "contexts")
    twice = contexts.where("c > 1").select("rule", "gram", "context")
    equal = shared.join(twice, ["rule", "gram", "context"], "left_semi")
    covered = _step(equal.select("piece", "rule", "places"), "equal")
    dropped(shared)

    # Further digits: zones of the contexts that differ, then parts of those zones, down to single windows.
    found = [covered]
    left = contexts.where("mixed").select("one.*", "rule", F.lit(0).cast("long").alias("zone"), F.col("gram").alias("seed"), "c")
    texts, spent = rows, contexts
    for level in range(max(len(rule.widths) for rule in rules)):
        sought = _sought(texts, left)
        if not level:
            sought = texts = _step(sought, "sought")  # all that later passes look at
        zones = _step(_zones(sought, rules, level), "zones")
        dropped(spent)
        cores = zones.groupBy("rule", "core").agg(F.count("*").alias("n"), (F.min("hull") != F.max("hull")).alias("mixed"))
        cores = _step(cores.where("n > 1").select("rule", "core", "mixed"), "cores")
        kept = _step(zones.join(cores, ["rule", "core"]), "zones-shared")
        dropped(zones)
        dropped(cores)
        one = F.struct("piece", "row", "pos", "zone")
        hulls = kept.groupBy("rule", "core", "hull", "mixed").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.min(one).alias("one"))
        hulls = _step(hulls.where("n > 1 or mixed"), "hulls")
        # What stands twice on a level above is covered already.
        twice = hulls.where("n > 1").select("rule", "core", "hull")
        found.append(_step(_marks(kept.where("c = 1").join(twice, ["rule", "core", "hull"], "left_semi")), "same"))
        dropped(kept)
        # Of equal hulls one stands for all.
        left = hulls.where("mixed").select("one.*", "rule", F.col("core").alias("seed"), F.greatest("n", "c").alias("c"))
        spent = hulls
    dropped(spent)
    dropped(texts)
    return reduce(DataFrame.unionByName, found)


def _spans(marks: DataFrame) -> DataFrame:
    """row, spans, passages: the union of a row's marks by the first rule, and of all its marks, as firsts and ends in turn."""

    def union(rows, row, low, high):
        """A list for each of rows."""
        if not len(row):
            return pa.array([[]] * len(rows), pa.list_(pa.int64()))
        order = np.lexsort((low, row))
        row, low, high = row[order], low[order], high[order]
        # Rows one after the other on one line, so that a running maximum does not leave its row.
        base = np.searchsorted(rows, row) * (high.max() + 2)
        reach = np.maximum.accumulate(base + high)
        head = np.flatnonzero(np.concatenate([[True], (base + low)[1:] > reach[:-1]]))
        last = np.append(head[1:], len(row)) - 1
        edges = np.stack([low[head], reach[last] - base[last]], 1).ravel()
        ends = np.append(np.searchsorted(row[head], rows), len(head)) * 2
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(edges.astype(np.int64)))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                piece, marks = batch.column(0)[i].as_py(), batch.column(1).slice(i, 1).flatten()
                sizes = pc.list_value_length(marks.field(1)).to_numpy(zero_copy_only=False) // PLACE
                rule = np.repeat(marks.field(0).to_numpy(zero_copy_only=False), sizes)
                row, unit, low, size = marks.field(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, PLACE).T
                row, low = row + piece, low + unit
                high = low + size
                rows, own = np.unique(row), rule == 0
                lists = [union(rows, row[own], low[own], high[own]), union(rows, row, low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(rows), *lists], ["row", "spans", "passages"])

    gathered = marks.groupBy("piece").agg(F.collect_list(F.struct("rule", "places")).alias("marks")).select("piece", "marks")
    return gathered.mapInArrow(run, "row bigint, spans array<bigint>, passages array<bigint>")


def _left(data: bytes, spans: list[int] | None) -> bytes:
    if not spans:
        return data
    edges = [0, *spans, len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


#: What remove_repeats can show of a document, with its type.
SHOWN = {
    "kept": "binary",  # what is left of the bytes
    "kept_sha256": "string",
    "rest": "binary",  # what is left if passages of repeated words go too
    "text": "string",  # the same as text; a character cut at the edge of a run goes with it
    "n_passage_bytes": "bigint",  # bytes that go from rest
}


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    words: int = 0,
    keep: tuple = (),
    shown: tuple = ("kept",),
) -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans (maximal removed runs) by the rule of bytes, and what is asked of SHOWN.

    With `words`, repeated windows of so many words go from rest and text too, however few bytes they have.
    The columns of `keep` come along as _k0, _k1 ...
    """
    names = [f"_k{i}" for i in range(len(keep))]
    carried: list[Column] = [F.col(c).alias(n) for c, n in zip((id_col, *keep), ("_id", *names), strict=True)]
    # Numbers stay the same once they are written.
    rows = bounded(docs).select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), *carried)
    rows = written(rows, "rows")
    rules = [Rule(length), Rule(words, by_words=True)] if words else [Rule(length)]
    least = min(length, 2 * words - 1) if words else length
    marks = repeated(rows.where(F.octet_length("text") >= least), rules)
    spans = _step(_spans(marks), "spans")
    dropped(marks)
    full = rows.join(spans.hint("merge"), "row", "left").select("_id", *names, "text", "spans", "passages")
    count = len(names) + 1
    kinds = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}

    def run(batches):
        for part in pieces(batches, "text"):
            out: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", *shown)}
            lists = (part.column(count + 1).to_pylist(), part.column(count + 2).to_pylist())
            for data, own, every in zip(as_bytes(part.column(count)), *lists, strict=True):
                kept = _left(data, own)
                rest = kept if own == every else _left(data, every)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(own or ()) // 2)
                for name in shown:
                    value = {
                        "kept": lambda: kept,  # noqa: B023
                        "kept_sha256": lambda: hashlib.sha256(kept).hexdigest(),  # noqa: B023
                        "rest": lambda: rest,  # noqa: B023
                        "text": lambda: rest.decode("utf-8", "ignore"),  # noqa: B023
                        "n_passage_bytes": lambda: len(data) - len(rest),  # noqa: B023
                    }[name]()
                    out[name].append(value)
            types = [pa.int64()] * 3 + [kinds[SHOWN[x]] for x in shown]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(count)), *(pa.array(c, k) for c, k in zip(out.values(), types, strict=True))],
                [*part.schema.names[:count], *out],
            )

    kind = "".join(f"`{x}` {ddl(docs, c)}, " for c, x in zip((id_col, *keep), ("_id", *names), strict=True))
    kind += "n_bytes bigint, n_removed bigint, n_spans bigint" + "".join(f", {x} {SHOWN[x]}" for x in shown)
    return full.mapInArrow(run, kind).withColumnRenamed("_id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = 0) -> DataFrame:
    """The rows, with all their columns, each text without its repeated bytes and passages; a null text stays null.

    A character that is cut at the edge of a removed run goes with it, so texts stay valid.
    """
    others = [c for c in docs.columns if c != text_col]
    names = {c: f"_k{i}" for i, c in enumerate(others)}
    empty = "_null" + "_" * max(len(c) for c in docs.columns)  # no other column's name
    rows = docs.withColumn(empty, F.col(text_col).isNull())
    found = remove_repeats(rows, empty, text_col, length, words, keep=tuple(others), shown=("text",))
    text = F.when(~F.col(empty), F.col("text"))
    return found.select(*((text if c == text_col else F.col(names[c])).alias(c) for c in docs.columns))
