"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows: the share of toxic and of other documents
that hold a token gives its log-odds under an informative Dirichlet prior whose
mass follows the token's overall frequency; the end of its confidence interval that is nearer to 0 is
its evidence, for or against. Evidence for is the token's score; every other token costs a small constant and its evidence against. In a text, all
maximal scoring segments are found in one linear scan (Ruzzo and Tompa); a segment's chance
in a text of that many tokens follows the extreme-value law of Karlin and Altschul with
parameters from the background distribution of scores. The passages that are significant add up to
one statistic, which a logistic curve, fitted on the other half of the sample, maps to a score.

Defined cases: null and empty texts and texts without tokens have no passages and the score of
a text with none. Without labelled rows of both kinds nothing is toxic and every score is 0. Rows
are independent, so repeated rows give equal results; an empty table gives an empty one;
texts of any length are scanned whole; further columns are not looked at.
"""

from __future__ import annotations

import math
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, ddl, pieces

TOKENS = re.compile(r"[^\W_]+")
#: Mass of the Dirichlet prior, in documents; standard errors that a token's log-odds are lowered by.
PRIOR_MASS = 200.0
LOWERED = 2.0
#: Random texts that the extreme-value law is fitted to, and positive tokens in each.
SEQUENCES, POSITIVES = 2000, 100
#: What a token without evidence adds to a segment, and one with evidence against on top of that.
DRIFT = -0.5
#: Expected number of equally good segments by chance, below which one is significant.
SIGNIFICANT = 0.05


def tokens(text: str | None) -> list[str]:
    return TOKENS.findall((text or "").lower())


def segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), given only the places with scores other than drift.

    Between two of these every token adds drift, so the scan is linear in their number.
    """
    found: list[list] = []  # start, end, total before it, total with it
    total, last = 0.0, -1
    for at, score in scored:
        total += drift * (at - last - 1)
        last = at
        if score <= 0:
            total += score
            continue
        item = [at, at + 1, total, total + score]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                found.append([*item, j])
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


class Model:
    """Token scores, parameters of the extreme-value law, and the curve."""

    def __init__(self, scores: dict[str, float], background: tuple[np.ndarray, np.ndarray]):
        self.scores = scores
        self.rate, self.scale = karlin_altschul(*background)
        self.curve = (0.0, 0.0)
        self.blank = not scores

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and (start token, end token, nats beyond chance) of the significant segments."""
        words, known = tokens(text), self.scores
        scored = [(i, known[w]) for i, w in enumerate(words) if w in known]
        if not scored:
            return len(words), []
        chance = math.log(self.scale * len(words))
        least = chance - math.log(SIGNIFICANT)
        found = [(a, b, self.rate * s) for a, b, s in segments(scored, DRIFT)]
        return len(words), [(a, b, s - chance) for a, b, s in found if s > least]

    @staticmethod
    def statistic(passages: list[tuple[int, int, float]]) -> float:
        return math.log1p(sum(s for _, _, s in passages))

    def score(self, statistic: float) -> float:
        if self.blank:
            return 0.0
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, a + b * statistic))))


def karlin_altschul(values: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """lambda and K of the law P(best segment of n tokens > x) = 1 - exp(-K n exp(-lambda x)).

    lambda solves sum(p exp(lambda s)) = 1. K is fitted to the best segments of SEQUENCES random texts of the background: of
    the positive tokens that each holds, and the cost of the others between them, whose number is geometric.
    """
    if not len(values) or values.max() <= 0:
        return 1.0, 0.1
    low, high = 1e-6, 1.0
    grown = lambda x: float((shares * np.exp(np.minimum(700.0, x * values))).sum())
    while grown(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    rate = (low + high) / 2
    good = values > 0
    often = float(shares[good].sum())
    rng = np.random.RandomState(7)
    gained = rng.choice(values[good], (SEQUENCES, POSITIVES), p=shares[good] / often)
    lost = (rng.geometric(min(1.0, often), gained.shape) - 1) * (shares[~good] @ values[~good] / max(1e-12, 1 - often))
    total = np.cumsum(gained + lost, 1)
    before = total - gained
    best = (total - np.minimum.accumulate(before, 1)).max(1)
    # The mean of the law is (ln(K n) + Euler's constant) / lambda.
    return rate, float(np.exp(rate * best.mean() - np.euler_gamma) * often / POSITIVES)


def _counts(sample: DataFrame) -> DataFrame:
    """token, documents of each label that hold it, and its occurrences in those of label 0."""

    def run(batches):
        for part in pieces(batches, "text"):
            out: dict[str, list[int]] = {}
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = tokens(text)
                if not label:
                    for w in words:
                        out.setdefault(w, [0, 0, 0])[2] += 1
                for w in set(words):
                    out.setdefault(w, [0, 0, 0])[label] += 1
            columns = [list(out), *(list(x) for x in zip(*out.values(), strict=True))] if out else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["token", "n0", "n1", "t0"]
            )

    counted = sample.select("text", F.col("label").cast("int")).mapInArrow(run, "token string, n0 long, n1 long, t0 long")
    return counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "t0")))


def fit(sample: DataFrame) -> Model:
    """sample: k, text, label of a bounded number of rows, repeated texts counted once."""
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "k").alias("text"), F.min_by("label", "k").alias("label"))
    half = F.pmod(F.col("h"), F.lit(2)) == 0
    learn, check = sample.where(half), sample.where(~half)
    docs = {r[0]: r[1] for r in learn.groupBy("label").count().collect()}
    n0, n1 = docs.get(0, 0), docs.get(1, 0)
    if not n0 or not n1:
        return Model({}, (np.zeros(0), np.zeros(0)))
    prior = F.lit(PRIOR_MASS) * (F.col("n0") + F.col("n1")) / F.lit(n0 + n1) + 0.01
    yes, no = F.col("n1") + prior, F.col("n0") + prior
    without1, without0 = n1 + PRIOR_MASS - yes, n0 + PRIOR_MASS - no
    odds = F.log(yes / without1) - F.log(no / without0)
    margin = LOWERED * F.sqrt(1 / yes + 1 / no)
    # Evidence against is found in frequent tokens, where the documents without one count as well.
    whole = LOWERED * F.sqrt(1 / yes + 1 / no + 1 / without1 + 1 / without0)
    table = _counts(learn).withColumn("score", F.when(odds > margin, odds - margin).when(odds < -whole, odds + whole + DRIFT))
    held = table.where("score is not null").orderBy(F.desc("score"), "token").collect()  # tokens of the bounded sample
    total = table.agg(F.sum("t0")).first()[0] or 0
    scores = {r["token"]: r["score"] for r in held}
    # The background: each token's occurrences in documents of label 0, with half of one for what never occurs there.
    values = np.array([*(r["score"] for r in held), DRIFT])
    seen = np.array([r["t0"] + 0.5 for r in held])
    weights = np.array([*seen, max(1.0, total - seen.sum())])
    model = Model(scores, (values, weights / weights.sum()))
    rows = passages(check, model, "h").join(check.select("h", "label"), "h").select("label", "statistic").collect()
    model.curve = logistic(np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and a slope of 0 or more, by Newton steps with a small ridge."""
    if not len(x):
        return -3.0, 1.0
    beta, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, gradient)
    return float(beta[0]), float(max(0.0, beta[1]))


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, score, statistic, n_tokens, passages (start and end token, nats beyond chance)."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # tokens of the bounded sample

    def run(batches):
        own = pickle.loads(held.value)
        place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("nats", pa.float64())]))
        for part in pieces(batches, text_col):
            rows = [own.passages(text) for text in part.column(1).to_pylist()]
            stats = [own.statistic(found) for _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([own.score(s) for s in stats], pa.float64()),
                    pa.array(stats, pa.float64()),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([[dict(zip(("start", "end", "nats"), x, strict=True)) for x in f] for _, f in rows], place),
                ],
                ["id", "score", "statistic", "n_tokens", "passages"],
            )

    schema = (
        f"`{id_col}` {ddl(docs, id_col)}, score double, statistic double, n_tokens bigint, "
        "passages array<struct<start:bigint,end:bigint,nats:double>>"
    )
    return bounded(docs).select(id_col, text_col).mapInArrow(run, schema)
