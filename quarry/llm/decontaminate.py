"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Item and document texts are normalised alike: A-Z lower-cased, words are runs of
ASCII digits, letters and characters beyond ASCII, joined by one space. A window
is 13 consecutive words of an item; an item of fewer words, but not none, is one
window. The automaton scans each text once; a match's offset gives its first word,
and word numbers map back to character offsets of the original text.

Defined cases: a null, empty or word-less document has no words and no hits; an
item without words or text has no window; windows of an item whose id is null
hit words, but name no item. Repeated rows of an item count once, repeated rows of a
document are judged apart. With an empty benchmark nothing is hit. Texts of any
length are scanned whole. Further columns are not looked at.

The automaton is broadcast. Its size is checked: windows are dealt to as many
automata of at most MAX_PATTERN_BYTES as they need, and the texts are scanned by
one after the other.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bounded, ddl, pieces

WINDOW = 13
#: Bytes of window texts that one broadcast automaton holds.
MAX_PATTERN_BYTES = 16 << 20

#: Byte to byte: A-Z to a-z, what is no part of a word to a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


_built: dict[bytes, ahocorasick.Automaton] = {}


def _automaton(patterns: list[tuple[str, int, list[int]]], key: bytes) -> ahocorasick.Automaton:
    """One for each worker process and set of patterns."""
    if key not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for text, n_words, items in patterns:
            found.add_word(text, (len(text), n_words, items))
        if patterns:
            found.make_automaton()
        _built[key] = found
    return _built[key]


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Word intervals that windows cover, merged, and the numbers of the items they belong to."""
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    if len(automaton):
        line = f" {b' '.join(words).decode('latin-1')} "
        at, n = 0, 0
        for end, (length, n_words, own) in automaton.iter(line):
            start = end - length + 1
            # Of matches that end together the longest comes first, so a start can lie before the last one.
            n = n + line.count(" ", at, start) if start >= at else n - line.count(" ", start, at)
            at = start
            spans.append((n, n + n_words))
            items.update(own)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of intervals of words."""
    if not spans:
        return []
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    raw = np.frombuffer(text, np.uint8)
    character = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(character[starts[a]]), int(character[ends[b - 1]])) for a, b in spans]


def _dealt(items: list, size: int) -> list[list[tuple[str, int, list]]]:
    """Windows with their word counts and items' numbers, in groups of bounded size."""
    owners: dict[bytes, set[int]] = {}
    for number, (_, text) in enumerate(items):
        for window in windows(words_of((text or "").encode()), size):
            owners.setdefault(window, set()).add(number)
    groups, room = [[]], MAX_PATTERN_BYTES
    for window in sorted(owners):
        if len(window) > room and groups[-1]:
            groups.append([])
            room = MAX_PATTERN_BYTES
        room -= len(window)
        groups[-1].append((f" {window.decode('latin-1')} ", window.count(b" ") + 1, sorted(owners[window])))
    return groups


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    carry: tuple = (),
) -> DataFrame:
    """A row per document: id, n_words, n_hit, items (ids as sorted strings), spans (characters hit).

    The columns of `carry` come along as carry0, carry1 ...

    The benchmark is a stated query set: it is read to the driver, where its windows are made.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id_col).cast("string"), F.col(item_text_col)).distinct().toLocalIterator()
    items = [(i, text) for i, text in rows]
    groups = _dealt(items, size)
    names = spark.sparkContext.broadcast([i for i, _ in items])
    kind = ddl(docs, id_col)
    along = [f"carry{i}" for i in range(len(carry))]
    along_kinds = "".join(f", {n} {ddl(docs, c)}" for n, c in zip(along, carry, strict=True))
    out = bounded(docs).select(
        F.col(id_col),
        F.col(text_col).alias("text"),
        F.lit(None).cast("binary").alias("found"),
        *(F.col(c).alias(n) for c, n in zip(carry, along, strict=True)),
    )
    for group in groups:
        patterns = spark.sparkContext.broadcast(group)
        key = hashlib.sha256(repr(group).encode()).digest()

        def run(batches, patterns=patterns, key=key):
            automaton = _automaton(patterns.value, key)
            for part in pieces(batches, "text"):
                found = []
                for text, before in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    spans, own = scan(automaton, words_of(text))
                    found.append(_pack(spans, own, before))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.binary()), *part.columns[3:]],
                    ["id", "text", "found", *along],
                )

        if group is groups[-1]:
            break
        out = out.mapInArrow(run, f"`{id_col}` {kind}, text string, found binary{along_kinds}")

    def finish(batches):
        automaton = _automaton(patterns.value, key)
        for part in pieces(batches, "text"):
            columns = [[], [], [], []]
            for text, before in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                words = words_of(text)
                spans, own = scan(automaton, words)
                if before:
                    spans, own = _unpack(_pack(spans, own, before))
                owners = sorted({names.value[i] for i in own} - {None})
                places = [{"start": a, "end": b} for a, b in offsets(text, spans)]
                for column, value in zip(columns, (len(words), sum(b - a for a, b in spans), owners, places), strict=True):
                    column.append(value)
            place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), place)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *part.columns[3:]],
                ["id", "n_words", "n_hit", "items", "spans", *along],
            )

    return out.mapInArrow(
        finish,
        f"`{id_col}` {kind}, n_words bigint, n_hit bigint, items array<string>, "
        f"spans array<struct<start:bigint,end:bigint>>{along_kinds}",
    )


def _pack(spans, own, before: bytes | None) -> bytes | None:
    """Intervals and items as 64-bit numbers, joined with those of the scans before; null for none."""
    if before:
        more, also = _unpack(before)
        spans, own = merged([*spans, *more]), own | also
    if not spans:
        return None
    return np.asarray([len(spans), *(x for s in spans for x in s), *sorted(own)], np.int64).tobytes()


def _unpack(data: bytes) -> tuple[list[tuple[int, int]], set[int]]:
    n, *rest = np.frombuffer(data, np.int64).tolist()
    return list(zip(rest[: 2 * n : 2], rest[1 : 2 * n : 2], strict=True)), set(rest[2 * n :])


def contaminated() -> F.Column:
    """The rule: some word is hit, and hit words are a twentieth of all at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the rule doesn't find contaminated."""
    found = decontaminate(docs, benchmark, id_col, text_col, carry=tuple(docs.columns))
    return found.where(~contaminated()).select(*(F.col(f"carry{i}").alias(c) for i, c in enumerate(docs.columns)))
