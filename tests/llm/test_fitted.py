"""Fitted operators and the pipeline."""

import random

import numpy as np
import pytest

from quarry.llm import quality, queries, toxicity
from quarry.llm.common import table
from quarry.llm.sampling import labelled_sample


@pytest.mark.parametrize(("query", "label", "least"), [("op8_quality", "quality", 0.8), ("op9_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, sf_dir, query, label, least):
    found = queries.queries()[query](spark, sf_dir)
    rows = found.join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r[label] for r in rows) >= least * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_edges(spark, odd, none):
    x = np.array([quality.figures("Some words here. " * n) for n in range(1, 60)] + [quality.figures("!!! $$$ " * n) for n in range(1, 60)])
    model = quality.Additive(x, np.array([1.0] * 59 + [0.0] * 59))
    scores = quality.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert model.score(x)[:59].min() > 0.5 > model.score(x)[59:].max()
    assert quality.score(none, model).count() == 0
    out = quality.accepted(odd, model, 0.0)
    assert out.columns == odd.columns and out.count() == odd.count()
    blank = quality.Additive(np.zeros((0, len(quality.FIGURES))), np.zeros(0))
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.5}


def brute_segments(scores):
    """All maximal scoring segments by their definition: take the best one, then go on left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max((round(sum(scores[a:b]), 9), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    a, b = -best[2], -best[2] - best[1]
    left = brute_segments(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*left, (a, b, best[0]), *right]


def test_segments_equal_their_definition():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-0.5, -0.5, -0.5, -0.9, -2.3, 1.3, 0.4, 2.1]) for _ in range(rng.randint(0, 24))]
        scored = [(i, s) for i, s in enumerate(scores) if s != -0.5]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scored, -0.5)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_toxicity_edges(spark, odd, none):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["tree", "house", "river", "cloud", "stone", "bird"]) for _ in range(30))
    rows = [(i, plain() + (" nasty vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(400)]
    rows = [(i, text if toxic or i % 2 else text + " thanks", toxic) for i, text, toxic in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "k long, text string, label int"))
    got = toxicity.passages(spark.createDataFrame([(1, plain() + " NASTY, vile " + plain()), (2, plain()), (3, None), (4, "")], "doc_id long, text string"), model)
    # Evidence against costs more than none; words of both kinds have next to none.
    assert model.scores["thanks"] < 1.5 * toxicity.DRIFT and model.scores["vile"] > 0
    assert all(abs(model.scores.get(w, toxicity.DRIFT) - toxicity.DRIFT) < 0.1 for w in ("tree", "house", "river", "cloud", "stone", "bird"))
    score = {r["doc_id"]: r for r in got.collect()}
    assert score[1]["score"] > 0.5 > score[2]["score"] and score[3]["score"] == score[4]["score"] < 0.5
    assert [(p["start"], p["end"]) for p in score[1]["passages"]] == [(30, 32)]
    assert toxicity.passages(odd, model).count() == odd.count() and toxicity.passages(none, model).count() == 0
    blank = toxicity.fit(spark.createDataFrame([], "k long, text string, label int"))
    assert {r["score"] for r in toxicity.passages(odd, blank).collect()} == {0.0}


def test_sample_is_bounded_and_clean(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(500)] + [(None, 1), (3, None), (4, 7), (5, 0), (5, 1)]
    table = spark.createDataFrame(labels, "doc_id long, q int")
    from pyspark.sql import functions as F

    got = labelled_sample(docs, table, "q", F.lit(True)).collect()
    assert len(got) == 500 and next(r["label"] for r in got if r["k"] == 5) == 1
    assert 20 < labelled_sample(docs, table, "q", F.lit(True), limit=50).count() < 90


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_dedup", "passage_dedup", "decontamination", "tokens"]
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/test-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.count()
        assert 0.5 * before < after <= before
        assert name == "passage_dedup" or after < before
        before = after
    rows = pipeline.run(spark, sf_dir)
    assert rows.count() == before
    assert rows.where("n_tokens <> size(ids)").count() == 0


def test_extreme_value_law_holds_for_random_texts():
    """Token by token: the share of random texts whose best segment passes the 5 % line, and the equation of lambda."""
    from quarry.llm import toxicity

    for values, shares in (([2.0, 0.7, toxicity.DRIFT], [0.02, 0.05, 0.93]), ([3.0, toxicity.DRIFT], [0.004, 0.996])):
        values, shares = np.array(values), np.array(shares)
        rate, scale = toxicity.karlin_altschul(values, shares)
        assert abs((shares * np.exp(rate * values)).sum() - 1) < 1e-6
        n = 4000
        line = np.log(scale * n / -np.log(0.95)) / rate
        drawn = np.random.RandomState(1).choice(values, (800, n), p=shares)
        total = np.cumsum(drawn, 1)
        low = np.minimum.accumulate(np.concatenate([np.zeros((800, 1)), total[:, :-1]], 1), 1)
        share = ((total - low).max(1) > line).mean()
        assert 0.01 < share < 0.12, (rate, scale, share)
