"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few figures about its characters, words and lines. Each figure is cut into
bins at quantiles; boosted shallow trees, fitted to one figure after the other in cycles, add up
to one lookup table per figure. The pairs of figures that explain most of what is left get
tables of two dimensions in the same way. A score is the logistic of the sum of looked-up
entries, all done on arrays.

Defined cases: null and empty texts have all figures 0 and get a score like any other. Without
labelled rows every score is 0.5; with one label only, near that label. Rows are
independent, so repeated rows give equal results; an empty table gives an empty one; texts
of any length are measured whole; further columns are not looked at.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import bounded, ddl, pieces

#: Bins per figure, and per side of a pair; trees have up to LEAVES leaves.
BINS, PAIR_BINS, LEAVES = 64, 12, 4
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 150, 60, 0.1, 8
#: Added to each leaf's second derivative, and the least of it that a leaf may have.
RIDGE, LEAST = 1.0, 2.0

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))
BLANKS = b" \t\n\r\x0b\x0c"
HIGH = bytes(range(0x80, 0x100))
MARKS = b".,;:'\"!?()-"
#: Names of the figures, in order.
FIGURES = (
    "length words word_length upper digits symbols high marks stops commas shouts bars lines line_words "
    "distinct_words distinct_lines ends_plain"
).split()


def figures(text: str | None) -> list[float]:
    data = (text or "").encode()
    n = len(data)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_words, size, rows = len(words), max(1, n), max(1, len(lines))
    each = max(1, n_words)
    count = lambda kinds: n - len(data.translate(None, kinds))
    upper, lower, digits, high, marks, blank = (count(x) for x in (UPPER, LOWER, DIGITS, HIGH, MARKS, BLANKS))
    symbols = n - upper - lower - digits - high - marks - blank
    return [
        np.log1p(n),
        np.log1p(n_words),
        (n - blank) / each,
        upper / max(1, upper + lower),
        digits / size,
        symbols / size,
        high / size,
        marks / size,
        data.count(b".") / each,
        data.count(b",") / each,
        data.count(b"!") / each,
        data.count(b"|") / each,
        np.log1p(len(lines)),
        n_words / rows,
        len(set(words)) / each,
        len(set(lines)) / rows,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / rows if lines else 0.0,
    ]


class Additive:
    """Bin edges and lookup tables, for single figures and for pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape if x.size else (0, len(FIGURES))
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1))) if n else 0.0
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        self.rough = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        if not n:
            return
        bins = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]
        margin = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(k):
                g, h = self._slopes(margin, y)
                step = RATE * _tree(*_sums(bins[j], g, h, len(self.tables[j])))
                self.tables[j] += step
                margin += step[bins[j]]
        rough = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.rough)]
        g, h = self._slopes(margin, y)
        gains = []
        for i, j in combinations(range(k), 2):
            shape = (len(self.rough[i]) + 1, len(self.rough[j]) + 1)
            gains.append((_quadrants(*_grid(rough[i], rough[j], g, h, shape))[0], i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs[i, j] = np.zeros((len(self.rough[i]) + 1, len(self.rough[j]) + 1))
        for _ in range(PAIR_ROUNDS):
            for (i, j), cells in self.pairs.items():
                g, h = self._slopes(margin, y)
                step = RATE * _quadrants(*_grid(rough[i], rough[j], g, h, cells.shape))[1]
                cells += step
                margin += step[rough[i], rough[j]]

    @staticmethod
    def _slopes(margin, y):
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="left")]
        for (i, j), cells in self.pairs.items():
            total += cells[np.searchsorted(self.rough[i], x[:, i]), np.searchsorted(self.rough[j], x[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _sums(bins, g, h, size):
    return np.bincount(bins, g, size), np.bincount(bins, h, size)


def _grid(a, b, g, h, shape):
    flat = a * shape[1] + b
    size = shape[0] * shape[1]
    return np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over ordered bins, grown by best gain to LEAVES leaves; the value of each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)

    def best(a, b):
        cuts = np.arange(a + 1, b)
        if not len(cuts):
            return 0.0, a
        fit = (ch[cuts] - ch[a] >= LEAST) & (ch[b] - ch[cuts] >= LEAST)
        gain = np.where(fit, worth(a, cuts) + worth(cuts, b) - worth(a, b), 0.0)
        at = int(gain.argmax())
        return float(gain[at]), int(cuts[at])

    leaves = [(0, len(g))]
    options = {leaves[0]: best(0, len(g))}
    while len(leaves) < LEAVES:
        leaf = max(leaves, key=lambda x: options[x][0])
        gain, cut = options[leaf]
        if gain <= 1e-9:
            break
        leaves.remove(leaf)
        for part in ((leaf[0], cut), (cut, leaf[1])):
            leaves.append(part)
            options[part] = best(*part)
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both sides at once, into four leaves: its gain and the value of each cell."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return np.stack([a, b, d, c[-1, -1] - a - b - d])

    gs, hs = four(cg), four(ch)
    value = gs / (hs + RIDGE)
    gain = np.where((hs >= 0.25).all(0), (gs * value).sum(0), 0.0)
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    total = cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    out = np.zeros(g.shape)
    if gain[r, c] > total:
        leaf = value[:, r, c]
        out[: r + 1, : c + 1], out[: r + 1, c + 1 :] = leaf[0], leaf[1]
        out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = leaf[2], leaf[3]
    return max(0.0, float(gain[r, c] - total)), out


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep and an array of figures."""

    def run(batches):
        for part in pieces(batches, "_text"):
            rows = [figures(text) for text in part.column(part.num_columns - 1).to_pylist()]
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(rows, pa.list_(pa.float64()))], [*part.schema.names[:-1], "x"]
            )

    kept = ", ".join(f"`{c}` {ddl(docs, c)}" for c in keep)
    return bounded(docs).select(*keep, docs[text_col].alias("_text")).mapInArrow(run, f"{kept}, x array<double>")


def fit(sample: DataFrame) -> Additive:
    """sample: text and label of a bounded number of rows; only figures come to the driver."""
    rows = sorted((r[0], tuple(r[1])) for r in measured(sample, ["label"]).collect())
    x = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    return Additive(x, np.array([r[0] for r in rows], float))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id and score."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # tables of fixed size

    def run(batches):
        own = pickle.loads(held.value)
        for part in pieces(batches, text_col):
            x = np.array([figures(text) for text in part.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(x), pa.float64())], ["id", "score"])

    return bounded(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {ddl(docs, id_col)}, score double")


def accepted(docs: DataFrame, model: Additive, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is the threshold or more."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # tables of fixed size
    at = docs.columns.index(text_col)
    named = [f"c{i}" if i != at else "text" for i in range(len(docs.columns))]

    def run(batches):
        own = pickle.loads(held.value)
        for part in pieces(batches, "text"):
            x = np.array([figures(text) for text in part.column(at).to_pylist()], float)
            yield part.filter(pa.array(own.score(x) >= threshold))

    plain = bounded(docs).toDF(*named)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
