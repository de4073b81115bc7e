"""The learned encoder against numpy's decomposition."""

import re

import numpy as np
import pytest

from quarry.operators import ask, lsa, postings, vectors

TEXTS = [
    "the cat sat on the mat", "a cat and a dog sat", "dogs chase cats on the mat", "stocks fell as markets closed", "markets rose and stocks gained",
    "the market for stocks closed early", "", None, "cat cat cat mat", "rain fell on the early market",
]


def matrix(texts, terms, idf):
    out = np.zeros((len(texts), len(terms)))
    for i, t in enumerate(texts):
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            out[i, terms.index(w)] += 1
        held = out[i] > 0
        out[i, held] = (1 + np.log(out[i, held])) * idf[held]
        out[i] /= np.linalg.norm(out[i]) or 1
    return out


def test_equals_decomposition(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string").repartition(3)
    model = lsa.fit(rows, dims=4, extra=40)
    full = matrix(TEXTS, model.terms, model.idf)
    u, s, vt = np.linalg.svd(full, full_matrices=False)
    assert np.allclose(model.strengths, s[:4], atol=1e-9)
    assert np.allclose(np.abs((model.directions * vt[:4].T).sum(0)), 1, atol=1e-9)
    want = full @ vt[:4].T
    want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = model.encode(TEXTS)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-9)
    df = np.array([sum(w in re.findall("[a-z0-9]+", (t or "")) for t in TEXTS) for w in model.terms])
    assert np.allclose(model.idf, np.log(1 + 8 / df)) and list(df) == sorted(df, reverse=True)


def test_a_narrow_basis_comes_close(spark):
    rng = np.random.RandomState(2)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6], 20)) for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    model = lsa.fit(rows, dims=6, extra=6, sharpen=2)
    s = np.linalg.svd(matrix(texts, model.terms, model.idf), compute_uv=False)[:6]
    assert np.allclose(model.strengths, s, rtol=0.01)
    got = model.encode(texts)
    near = got @ got.T
    same = np.equal.outer(np.arange(300) % 6, np.arange(300) % 6)
    assert near[same].min() > near[~same].max()


def test_near_copies_come_first(spark, tmp_path):
    rng = np.random.RandomState(1)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words, 60) for _ in range(80)]
    copies = [np.where(rng.rand(60) < 0.15, rng.choice(words, 60), b) for b in base[:20]]
    rows = spark.createDataFrame([(i, i, "d", " ".join(b)) for i, b in enumerate(base)], "id long, ord long, pdf_name string, text string")
    model = lsa.fit(rows, dims=48)
    ask.build(rows, str(tmp_path / "index"), embedder=model)
    asked = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(copies)], "qid int, question string")
    near = vectors.topk(vectors.embed(asked, model, "qid", "question"), postings.Index(spark, str(tmp_path / "index")).chunks(), 1).collect()
    assert all(r["qid"] == r["id"] for r in near) and len(near) == 20


def test_bounds_and_edges(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    few = lsa.fit(rows, dims=3, terms=5)
    assert len(few.terms) == 5 and few.dims == 3
    assert lsa.fit(rows.limit(1), dims=64).dims == 5  # as many as there are terms
    got = few.encode(["", None, "unheard of", TEXTS[0]])
    assert not got[:3].any() and np.isclose(np.linalg.norm(got[3]), 1) and few.encode([]).shape == (0, 3)
    with pytest.raises(ValueError, match="no text"):
        lsa.fit(rows.limit(0))


def test_texts_are_tokenised_twice_whatever_the_passes(spark, monkeypatch):
    """Once for the vocabulary and once for the weights, which all passes read."""
    rows = [(i, f"alpha w{i % 7} beta w{i % 5}" if i % 9 else None) for i in range(60)]
    corpus = spark.createDataFrame(rows, "id int, text string")
    seen = []
    for name in ("_spread", "_gram"):
        inner = getattr(lsa, name)
        monkeypatch.setattr(lsa, name, lambda texts, m, f=inner: seen.append(texts.columns) or f(texts, m))
    model = lsa.fit(corpus, dims=3, extra=2, sharpen=2)
    assert seen == [["at", "w"]] * 4 and model.dims == 3
    assert np.allclose(np.linalg.norm(model.encode(["alpha beta", "", None]), axis=1), [1, 0, 0])
    whole = lsa.product(np.array([0, 0, 2]), np.array([1, 0, 1]), np.array([1.0, 2.0, 3.0]), 3, np.eye(2))
    monkeypatch.setattr(lsa, "PART", 1)
    assert np.array_equal(lsa.product(np.array([0, 0, 2]), np.array([1, 0, 1]), np.array([1.0, 2.0, 3.0]), 3, np.eye(2)), whole)
