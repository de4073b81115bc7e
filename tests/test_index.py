"""Versions of tables, positions, the keyword index and the vector joins."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import words
from quarry.functions.text import tokens
from quarry.operators import approximate, bm25, nearest, order, postings, vectors
from quarry.sources import readers, scratch, sinks, versions


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("place")).repartition(7)
    got = order.numbered(rows, ["k"], "at", start=5).collect()
    assert [r["at"] for r in sorted(got, key=lambda r: r["k"])] == list(range(5, 1005))
    assert order.numbered(rows.limit(0), ["k"]).collect() == []
    equal = order.numbered(rows.select(F.lit(1).alias("k")), ["k"]).collect()
    assert sorted(r["n"] for r in equal) == list(range(1000))
    plan = order.numbered(rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


class Broken(versions.Store):
    """A store whose n-th operation fails, before it is done or after."""

    def __init__(self, spark, path, at, done):
        super().__init__(spark, path)
        self.at, self.done, self.n = at, done, 0

    def _tried(self, run, *args):
        self.n += 1
        if self.n == self.at and not self.done:
            raise OSError("broken before")
        out = run(*args)
        if self.n == self.at and self.done:
            raise OSError("broken after")
        return out

    def names(self, *a):
        return self._tried(super().names, *a)

    def read(self, *a):
        return self._tried(super().read, *a)

    def create(self, *a):
        return self._tried(super().create, *a)

    def delete(self, *a):
        return self._tried(super().delete, *a)


def test_an_index_is_always_there(spark, tmp_path, monkeypatch):
    whole = versions.Store
    rows = lambda n: spark.createDataFrame([(f"{i}", n) for i in range(3)], "id string, n int")
    for n in (0, 1, 2):
        sinks.index(rows(n), str(tmp_path / "t"))
    seen, failed = 2, 0
    for at in range(1, 11):
        for done in (False, True):
            monkeypatch.setattr(versions, "Store", lambda s, p, at=at, done=done: Broken(s, p, at, done))
            new = 10 * at + done
            try:
                sinks.index(rows(new), str(tmp_path / "t"))
                ended = True
            except OSError:
                ended, failed = False, failed + 1
            monkeypatch.setattr(versions, "Store", whole)
            held = {r["n"] for r in readers.vectors(spark, str(tmp_path / "t")).collect()}
            assert held in ({seen}, {new}) and (held == {new} or not ended)
            seen = held.pop()
    assert failed > 6
    sinks.index(rows(7), str(tmp_path / "t"))
    assert len(list((tmp_path / "t" / "manifests").glob("0*"))) <= versions.KEPT + 1


def test_half_written_and_foreign_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    sinks.index(rows, str(tmp_path / "t"))
    (tmp_path / "t" / "manifests" / "0000000002").write_text('{"folders": ["tab')
    assert readers.vectors(spark, str(tmp_path / "t")).count() == 1
    sinks.index(rows.union(rows.selectExpr("'b'", "2")), str(tmp_path / "t"))
    assert readers.vectors(spark, str(tmp_path / "t")).count() == 2
    store = versions.Store(spark, str(tmp_path / "t"))
    with pytest.raises(RuntimeError, match="meanwhile"):
        versions.commit(store, {"folders": []}, after=1)
    with pytest.raises(Exception):
        store.create("manifests/0000000003", "{}")  # taken
    assert versions.current(store)[0] == 3


def corpus_of(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    words = ["the", "of", *(f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(60))]
    texts = [" ".join(["the"] * (i % 3) + rng.choices(words, k=rng.randrange(0, 40))) for i in range(n)]
    texts[::50] = ["zebra " * (1 + i % 3) + t for i, t in enumerate(texts[::50])]
    rows = [(f"c{start + i}", start + i, "doc", t if i % 97 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, ord int, pdf_name string, text string")


QUESTIONS = ["zebra", "the zebra of w7", "the the", "unheard of", "nothing-known", "", "w1 w2 w3 w7 zebra the of and"]


def same_answers(found, want):
    key = lambda r: (r["qid"], r["bm25_rank"])
    got, want = sorted(found.collect(), key=key), sorted(want.collect(), key=key)
    assert [(r["qid"], r["id"], r["ord"], r["bm25_rank"]) for r in got] == [(r["qid"], r["id"], r["ord"], r["bm25_rank"]) for r in want]
    assert all(abs(a["score"] - b["score"]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_index_answers_like_bm25(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string")
    corpus, path = corpus_of(spark, 900), str(tmp_path / "index")
    postings.build(corpus, path, buckets=8)
    index = postings.Index(spark, path)
    for k in (1, 30):
        same_answers(postings.topk(asked, index, k), bm25.topk(asked, corpus, k))
    # Blocks that can't win are left out.
    rare = asked.where("qid in (0, 1)")
    _, every, left = postings.candidates(index, rare, 1)
    assert left.count() < every.count() / 3


def test_search_reads_asked_terms_only(spark, tmp_path):
    corpus, path = corpus_of(spark, 200), str(tmp_path / "index")
    postings.build(corpus, path, buckets=16)
    asked = spark.createDataFrame([(1, "zebra")], "qid int, question string")
    index = postings.Index(spark, path)
    weighted = postings.weights(index, bm25.question_terms(asked))
    plan = postings.bounds(index, weighted)._jdf.queryExecution().executedPlan().toString()
    number = spark.range(1).select(postings.bucket(F.lit("zebra"), 16)).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {number}\)?[,\]]", plan), plan
    scan = next(x for x in plan.split("\n") if "max_tf" in x and "FileScan" in x)
    assert "docs" not in scan.split("ReadSchema")[1]
    # No text of the corpus is read, and so none is tokenised.
    for part in (postings.bounds(index, weighted), postings.scored(index, weighted, postings.bounds(index, weighted))):
        assert not re.search(r"ReadSchema: struct<[^>]*\btext:", part._jdf.queryExecution().executedPlan().toString())


def test_segments_answer_like_a_rebuild(spark, tmp_path):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string")
    parts = [corpus_of(spark, 150, seed, 1000 * seed) for seed in (3, 1, 2, 0)]
    path = str(tmp_path / "index")
    postings.build(parts[0], path, buckets=4)
    for p in parts[1:]:
        postings.append(p, path)
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    want = bm25.topk(asked, whole, 5)
    assert len(postings.Index(spark, path).segments) == 4
    same_answers(postings.topk(asked, postings.Index(spark, path), 5), want)
    old = postings.Index(spark, path)
    postings.merge(spark, path)
    assert len(postings.Index(spark, path).segments) == 1
    same_answers(postings.topk(asked, postings.Index(spark, path), 5), want)
    same_answers(postings.topk(asked, old, 5), want)  # who opened it before the merge still reads it
    with pytest.raises(ValueError, match="has"):
        postings.append(parts[2].limit(1), path)
    with pytest.raises(ValueError, match="twice"):
        postings.build(parts[2].union(parts[2]), path)
    assert postings.Index(spark, path).n_docs == 600


@pytest.mark.parametrize("texts", [["the the", "the cat", "the dog"], ["same words here"] * 5, ["only one"], ["", None], []])
def test_index_of_tiny_corpora(spark, tmp_path, texts):
    """Negative idf values, fewer chunks than k, chunks without a term, no chunks."""
    corpus = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "id string, ord int, text string")
    asked = spark.createDataFrame([(1, "the dog"), (2, "same words"), (3, ""), (4, None)], "qid int, question string")
    postings.build(corpus, str(tmp_path / "i"), buckets=2)
    same_answers(postings.topk(asked, postings.Index(spark, str(tmp_path / "i")), 3), bm25.topk(asked, corpus, 3))


def test_scores_below_zero_are_padded_in_order(spark):
    scored = spark.createDataFrame([(1, f"c{i}", i, -1.0 - i) for i in range(40)] + [(1, "c50", 50, 0.0), (2, "c3", 3, 1.0)], "qid int, id string, ord int, score double")
    corpus = spark.createDataFrame([(f"c{i}", i) for i in range(60)], "id string, ord int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    got = {(r["qid"], r["bm25_rank"]): r["ord"] for r in bm25.ranked(scored, asked, corpus, 2, "ord").collect()}
    assert got == {(1, 1): 40, (1, 2): 41, (2, 1): 3, (2, 2): 0, (3, 1): 0, (3, 2): 1}


def brute(q, x, k):
    far = ((x - q) ** 2).sum(1)
    return sorted(range(len(x)), key=lambda j: (round(far[j], 9), j))[:k]


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, start + i, v.tolist()) for i, v in enumerate(x)], "id long, ord long, vector array<double>")


@pytest.mark.parametrize("dims,spread", [(2, 0.05), (12, 0.3)])
def test_nearest_join_equals_model(spark, dims, spread):
    rng = np.random.RandomState(dims)
    x = rng.randn(10, dims)[rng.randint(0, 10, 700)] + rng.randn(700, dims) * spread
    x[300:500] = x[300]  # one vector in a large part of the rows
    odd = [(9000, 9000, None), (9001, 9001, []), (9002, 9002, [1.0]), (9003, 9003, [None] * dims), (9004, 9004, [math.nan] * dims)]
    corpus = frame(spark, x).unionByName(spark.createDataFrame(odd, "id long, ord long, vector array<double>")).repartition(5)
    q = np.concatenate([x[::40], rng.randn(20, dims) * 3])
    asked = frame(spark, q).selectExpr("id as qid", "vector").union(spark.createDataFrame([(800, None), (801, [2.0]), (802, [1.0, 2.0, 3.0])], "qid long, vector array<double>"))
    rows = nearest.topk(asked, corpus, 5, size=32, limit=40).collect()
    for i in range(len(q)):
        assert [r["id"] for r in sorted((r for r in rows if r["qid"] == i), key=lambda r: r["sem_rank"])] == brute(q[i], x, 5), i
    assert [(r["qid"], r["id"], r["distance"]) for r in rows if r["qid"] >= 800] == [(801, 9002, 1.0)]


def test_nearest_join_leaves_out_what_is_far(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(40, 4)[rng.randint(0, 40, 2000)] * 5 + rng.randn(2000, 4) * 0.2
    corpus, asked = frame(spark, x), frame(spark, x[::20]).selectExpr("id as qid", "vector")
    queries, rows, listed, first, _, left = nearest.visited(asked, corpus, 4, scratch.Workspace(spark), size=32)
    met = first.count() + left.count()
    assert listed.agg(F.max("n")).first()[0] <= 2 * 32
    assert met < 0.2 * listed.count() * queries.count()


def test_tables_of_a_call_go(spark, tmp_path):
    """What stays of a search is its result."""
    import pathlib

    top = pathlib.Path(scratch.scratch(spark, "x").removeprefix("file://")).parent
    corpus, asked = corpus_of(spark, 60), spark.createDataFrame([(1, "zebra the")], "qid int, question string")
    postings.build(corpus, str(tmp_path / "i"), buckets=2)
    x = frame(spark, np.random.RandomState(1).randn(50, 3))
    for run in (lambda: bm25.topk(asked, corpus, 3), lambda: postings.topk(asked, postings.Index(spark, str(tmp_path / "i")), 3), lambda: nearest.topk(x.selectExpr("id as qid", "vector"), x, 2)):
        before = {p.name for p in top.iterdir()}
        rows = run()
        assert len({p.name for p in top.iterdir()} - before) == 1 and rows.count() > 0


def test_few_queries_are_broadcast_and_many_joined(spark, monkeypatch):
    rng = np.random.RandomState(3)
    x, q = rng.randn(120, 6), rng.randn(12, 6)
    corpus, asked = frame(spark, x), frame(spark, q).selectExpr("id as qid", "vector")
    one = sorted(map(tuple, vectors.topk(asked, corpus, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 5)
    many = sorted(map(tuple, vectors.topk(asked, corpus, 3).collect()))
    assert one == many and len(one) == 36


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "id long, ord long, vector array<double>"), frame(spark, np.eye(3))
    for asked, corpus in ((none, some), (some, none), (none, none)):
        assert nearest.topk(asked.selectExpr("id as qid", "vector"), corpus, 2).collect() == []


def test_approximate_index_finds_most(spark, tmp_path):
    rng = np.random.RandomState(5)
    x = rng.randn(60, 32)[rng.randint(0, 60, 3000)] + rng.randn(3000, 32) * 0.5
    x[:900] = x[0]  # a cell with a third of all rows
    corpus, asked = frame(spark, x), frame(spark, x[::30]).selectExpr("id as qid", "vector")
    approximate.build(corpus, str(tmp_path / "ann"), centroids=50)
    index = approximate.Index(spark, str(tmp_path / "ann"))
    assert index.codes.count() == 3000  # every row is indexed
    got = {(r["qid"], r["distance"]) for r in approximate.topk(asked, index, 4).collect()}
    want = [(r["qid"], r["distance"]) for r in nearest.topk(asked, corpus, 4).collect()]
    assert sum(w in got for w in want) >= 0.9 * len(want)


def test_recall_on_the_table(spark, sf_dir):
    import __spark_entry__ as entry

    key = lambda rows: [(r["qid"], r["distance"]) for r in rows]
    want = key(entry.queries()["vector_topk"](spark, sf_dir).collect())
    got = set(key(entry.queries()["ann_topk"](spark, sf_dir).collect()))
    assert sum(w in got for w in want) >= 0.9 * len(want)


def test_approximate_edges(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        approximate.Index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no vectors"):
        approximate.build(spark.createDataFrame([], "id long, ord long, vector array<double>"), str(tmp_path / "e"))
    odd = spark.createDataFrame([(9, 9, None), (8, 8, [1.0])], "id long, ord long, vector array<double>")
    approximate.build(frame(spark, np.eye(3)).unionByName(odd), str(tmp_path / "few"))
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [1.0])], "qid long, vector array<double>")
    got = approximate.topk(asked, approximate.Index(spark, str(tmp_path / "few")), 2).collect()
    assert [(r["qid"], r["id"], r["distance"]) for r in sorted(got, key=lambda r: r["sem_rank"])] == [(1, 0, 0.0), (1, 1, 2.0)]


def test_postings_are_not_shuffled_and_few_scores_leave_a_task(spark, tmp_path, monkeypatch):
    seen = {}
    for name in ("_postings", "_best"):
        inner = getattr(postings, name)
        monkeypatch.setattr(postings, name, lambda *a, n=name, f=inner: seen.setdefault(n, f(*a)))
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(bm25, "ROWS", 16)
    corpus, path = corpus_of(spark, 1500), str(tmp_path / "index")
    asked = spark.createDataFrame([(i, f"the of w{i}") for i in range(12)], "qid int, question string")
    postings.build(corpus, path, buckets=4)
    assert "Exchange" not in seen["_postings"]._jdf.queryExecution().executedPlan().toString()
    same_answers(postings.topk(asked, postings.Index(spark, path), 3), bm25.topk(asked, corpus, 3))
    assert seen["_best"].count() < 12 * 1500 / 4


def test_ties_of_segments_go_by_corpus_order(spark, tmp_path, monkeypatch):
    rows = lambda at: spark.createDataFrame([(f"c{i}", i, "same words" if i % 5 else "other") for i in at], "id string, ord int, text string")
    path, asked = str(tmp_path / "index"), spark.createDataFrame([(1, "words"), (2, "other none")], "qid int, question string")
    postings.build(rows(range(1, 300, 2)), path, buckets=2)
    postings.append(rows(range(0, 300, 2)), path)
    want = bm25.topk(asked, rows(range(300)), 7)
    same_answers(postings.topk(asked, postings.Index(spark, path), 7), want)
    monkeypatch.setattr(bm25, "PAIRS", 0)  # by shuffles
    same_answers(postings.topk(asked, postings.Index(spark, path), 7), want)


def test_a_part_has_one_row_for_a_term(spark, monkeypatch):
    """Rows grow with parts of bounded size and not with blocks, and hold every chunk of a term once."""
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "PART", 4000)
    texts = [f"the w{i % 3} w{i % 3} İ{i}" if i % 10 else None for i in range(800)]
    rows = spark.createDataFrame([(i + (i >= 700) * 2**33, t) for i, t in enumerate(texts)], "n long, text string").coalesce(1)
    made = postings._postings(rows).collect()
    keys = [(r["term"], r["part"]) for r in made]
    parts = sorted({p for _, p in keys})
    assert len(set(keys)) == len(keys) and 2**33 + 700 in parts and 3 <= len(parts) < 10
    assert all(p % 8 == 0 for p in parts if p < 2**33)
    got = {}
    for r in made:
        docs = np.frombuffer(bytes(r["docs"]), postings.DOC)
        assert r["held"] == len(docs) == r["ends"][-1] and r["tokens"] == docs["tf"].sum()
        for low, high, block, tf, dl in zip([0, *r["ends"]], r["ends"], r["block"], r["max_tf"], r["min_dl"], strict=False):
            own = docs[low:high]
            assert tf == own["tf"].max() and dl == own["dl"].min()
            assert {(r["part"] + int(a)) // 8 for a in own["at"]} == {block}
        for at, tf, dl in docs.tolist():
            assert got.setdefault((r["term"], r["part"] + at), (tf, dl)) == (tf, dl)
    want = {}
    for r in rows.collect():
        found = re.findall("[a-z0-9]+", (r["text"] or "").lower())
        want |= {(w, r["n"]): (found.count(w), len(found)) for w in found}
    assert got == want


def test_an_index_of_another_layout_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "LAYOUT", 1)
    postings.build(corpus_of(spark, 20), str(tmp_path / "index"), buckets=2)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="layout"):
        postings.Index(spark, str(tmp_path / "index"))


def test_words_of_many_texts(spark):
    texts = [None, "", " -- ", "The the\tcat's", "İstanbul K2 ß ǅ9", "x" * 300, "日本 a1", "end", "\x00a\x00b\u2028c"]
    counts, found = words.coded(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r["w"] or [] for r in rows.select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()]
    assert counts.tolist() == [len(w) for w in want] and found.to_pylist() == [w for x in want for w in x]
    assert words.coded([])[0].tolist() == [] and words.coded([None])[1].to_pylist() == []
    monkey = pa.array(["a" * 30, None, "b", "c" * 5])
    assert [n for _, n in words.slices(monkey, 2)] == [2, 2] and list(words.slices(monkey[:0], 2)) == []


def test_a_token_is_hashed_and_looked_up_once_in_a_part():
    asked = []

    class Seen(vectors._Codes):
        def __getitem__(self, token):
            asked.append(token)
            return super().__getitem__(token)

    embedder = vectors.HashingEmbedder(8)
    embedder.codes = Seen(embedder.place)
    embedder.encode(["a b a", "b a a a"] * 20)
    assert sorted(asked) == ["a", "b"]
