"""BM25, vectors and fusion against plain models."""

import math
import re
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import bm25, fusion, vectors


def ranked(texts, question, k):
    tok = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    avg = sum(map(len, tok)) / len(tok)
    df = Counter(w for t in tok for w in set(t))
    raw = {w: math.log(len(tok) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    scores = []
    for t in tok:
        c = Counter(t)
        scores.append(sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall("[a-z0-9]+", question.lower())))
    order = sorted(range(len(texts)), key=lambda i: (-round(scores[i], 9), i))[:k]
    return [(i, round(scores[i], 6)) for i in order]


@pytest.mark.parametrize(
    "texts",
    [
        ["the cat sat", "the dog ran far", "a cat and a dog", "", "birds fly high", "The Cat cat CAT"],
        ["same words here", "same words here", "same words here"],
        ["only one"],
        ["the the", "the cat", "the dog"],
    ],
)
def test_bm25_equals_model(spark, texts):
    questions = ["cat", "the the dog", "nothing known", "", "same one words", "cat dog birds the"]
    corpus = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "id string, ord int, text string")
    asked = spark.createDataFrame(list(enumerate(questions)), "qid int, question string")
    rows = bm25.topk(asked, corpus, 4).collect()
    for q, question in enumerate(questions):
        got = [(r["ord"], r["score"] + 0.0) for r in sorted((r for r in rows if r["qid"] == q), key=lambda r: r["bm25_rank"])]
        assert got == [(i, pytest.approx(s, abs=2e-6)) for i, s in ranked(texts, question, 4)], question


def test_vectors_equal_model(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.RandomState(1)
    x, q = rng.randn(60, 5), rng.randn(7, 5)
    x[10] = x[20] = x[30]
    q[0] = x[10]
    corpus = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)] + [(99, 99, None), (98, 98, [1.0])], "id int, ord int, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(50, None)], "qid int, vector array<double>")
    rows = vectors.topk(asked, corpus.repartition(4), 4).collect()
    for i in range(7):
        got = [r["id"] for r in sorted((r for r in rows if r["qid"] == i), key=lambda r: r["sem_rank"])]
        d = ((x - q[i]) ** 2).sum(1)
        assert got == sorted(range(60), key=lambda j: (round(d[j], 9), j))[:4]
    assert len(rows) == 28


def test_embedder_is_unit_or_zero():
    found = vectors.HashingEmbedder(16).encode(["a b c a", "", None])
    assert found.shape == (3, 16) and np.allclose((found**2).sum(1), [1, 0, 0])


def test_fusion_order(spark):
    semantic = spark.createDataFrame([(1, x, n) for n, x in enumerate("abcd", 1)], "qid int, id string, sem_rank int")
    keyword = spark.createDataFrame([(1, x, n) for n, x in enumerate("xbya", 1)], "qid int, id string, bm25_rank int")
    got = [r["id"] for r in fusion.rrf(semantic, keyword).orderBy("rank").collect()]
    scores = {}
    for ids in ("abcd", "xbya"):
        for n, x in enumerate(ids, 1):
            scores[x] = scores.get(x, 0) + 1 / (60 + n)
    assert got == sorted(scores, key=lambda x: -scores[x]) and set(got[:2]) == {"a", "b"}


def test_unknown_ids_drop_after_the_cut(spark):
    fused = spark.createDataFrame([(1, x, n) for n, x in enumerate("abcde", 1)], "qid int, id string, rank int")
    corpus = spark.createDataFrame([("a", "A"), ("c", "C"), ("e", "E")], "id string, text string")
    assert sorted(r["id"] for r in fusion.with_texts(fused, corpus).collect()) == ["a", "c"]


@pytest.mark.parametrize("limits", [{"ROWS": 3, "CELLS": 6, "HELD": 2}, {"PAIRS": 0}])
def test_bm25_in_blocks_and_by_shuffles(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bm25, name, value)
    texts = [["the cat", "a dog and the dog", "", "İ K cat"][i % 4] + " x" * (i % 3) for i in range(40)]
    questions = ["cat", "the the dog", "nothing known", "", "x cat", "i k"]
    corpus = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "id string, ord int, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(questions)), "qid int, question string")
    rows = bm25.topk(asked, corpus, 4).collect()
    for q, question in enumerate(questions):
        got = [(r["ord"], r["score"] + 0.0) for r in sorted((r for r in rows if r["qid"] == q), key=lambda r: r["bm25_rank"])]
        assert got == [(i, pytest.approx(s, abs=2e-6)) for i, s in ranked(texts, question, 4)], question


def test_bm25_hands_on_few_rows(spark, monkeypatch):
    """No row for each question and text leaves a task: some for each question do."""
    seen = []
    inner = bm25._scored
    monkeypatch.setattr(bm25, "_scored", lambda *a: seen.append(inner(*a)) or seen[-1])
    corpus = spark.createDataFrame([(i, i, f"the cat w{i}") for i in range(3000)], "id int, ord int, text string").repartition(2)
    bm25.topk(spark.createDataFrame([(i, f"the cat of w{i}") for i in range(20)], "qid int, question string"), corpus, 4)
    assert seen[0].count() < 20 * 3000 / 10


def test_counts_are_added_up_before_they_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(bm25, "HELD", 20)
    monkeypatch.setattr(bm25, "ROWS", 16)
    corpus = MagicMock()
    bm25.frequencies(corpus)
    run = corpus.select.return_value.mapInArrow.call_args[0][0]
    texts = [None if i % 50 == 0 else " ".join(f"w{(i * 7 + j) % 30}" for j in range(9)) + " w0 W0" for i in range(2000)]
    rows = [tuple(r.values()) for b in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r in b.to_pylist()]
    got, want = Counter(), Counter(w for t in texts if t for w in set(t.lower().split()))
    for term, n, _ in rows:
        got[term] += n
    assert got.pop(None) == 2000 and got == want and sum(r[2] for r in rows) == 11 * 1960
    assert len(rows) < 2000


def test_known_terms_of_many_texts():
    row, term, tf, lengths = bm25._known(["the cat", None, "a Dog and the dog"], pa.array(["dog", "the"]))
    assert list(zip(row, term, tf, strict=True)) == [(0, 1, 1), (2, 0, 2), (2, 1, 1)] and lengths.tolist() == [2, 0, 5]
    assert bm25._known(["x"], pa.array([], pa.string()))[3].tolist() == [1]
