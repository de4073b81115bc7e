"""Readers, writers, the stream, the entry module."""

import importlib
import sys

import pytest
from pyspark.sql import functions as F

from quarry.operators import ask, bm25, postings
from quarry.sources import readers, scratch, sinks
from quarry.streaming import ingest


def test_markdown_and_text(spark, tmp_path):
    (tmp_path / " b guide .md").write_bytes(b"x\r\ny\rz")
    (tmp_path / "a.md").write_text("two")
    (tmp_path / "skip.txt").write_text("1. q\n\n2. r s")
    got = [tuple(r) for r in readers.markdown(spark, str(tmp_path)).orderBy("file_name").collect()]
    assert got == [(" b guide .md", "b guide", "x\ny\nz"), ("a.md", "a", "two")]
    assert [tuple(r) for r in readers.lines(spark, str(tmp_path / "skip.txt")).collect()] == [(1, "1. q"), (2, ""), (3, "2. r"), (4, "s")]
    assert readers.whole_text(spark, str(tmp_path / "a.md")).first()[0] == "two"


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "é")], "qid int, answer string")
    sinks.jsonl(rows, str(tmp_path / "out"), ["qid"])
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == '{"qid":1,"answer":"é"}\n{"qid":2,"answer":null}\n'
    (tmp_path / "in.jsonl").write_text('{"qid": 1, "chunk_ids": ["a"]}\n\n{"qid": 2, "chunk_ids": []}\n')
    assert readers.jsonl(spark, str(tmp_path / "in.jsonl"), readers.FROZEN_SOURCES).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"qid": 1}\nnot json\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), readers.FROZEN_SOURCES).collect()
    assert len(readers.jsonl(spark, str(tmp_path / "bad.jsonl"), readers.FROZEN_SOURCES, strict=False).collect()) == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('pdf_name,source_org,title,date_accessed,notes\n\n padded ,,T,2026-01-05,"a, b"\n\nx,O,U,2026-01-06,\n')
    got = [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.csv")).collect()]
    assert [(g[0], g[1], str(g[3]), g[4]) for g in got] == [(" padded ", None, "2026-01-05", "a, b"), ("x", "O", "2026-01-06", None)]


class Reverse:
    def markdown(self, content):
        if content == b"?":
            raise ValueError("unreadable")
        return content.decode()[::-1]


def test_conversion_isolates_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.pdf").write_bytes(b"?")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r["file_name"]: (r["text"], r["error"]) for r in readers.converted(readers.pdfs(spark, str(tmp_path)), Reverse()).collect()}
    assert got == {"a.pdf": ("cba", None), "b.pdf": (None, "ValueError: unreadable")}
    assert readers.pdfs(spark, str(tmp_path)).count() == 2


def test_html(spark):
    html = '<html><head><script>var a="</p>";</script><style>p{}</style></head><body><h1>T &amp; U</h1><p>one<br>two</p><ul><li>x</li></ul></body></html>'
    assert spark.range(1).select(readers.html_markdown(F.lit(html))).first()[0] == "# T & U\none\ntwo\n- x"


def test_index_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    sinks.index(rows, str(tmp_path / "index"))
    sinks.index(rows, str(tmp_path / "index"))
    assert readers.vectors(spark, str(tmp_path / "index")).count() == 2
    with pytest.raises(ValueError, match="twice"):
        sinks.index(rows.union(rows), str(tmp_path / "index"))
    assert readers.vectors(spark, str(tmp_path / "index")).count() == 2  # the old one stays
    assert [p.name for p in tmp_path.iterdir() if "index" in p.name and p.suffix in (".new", ".old")] == []
    sinks.append_missing(rows.limit(1), str(tmp_path / "done"), "id")
    sinks.append_missing(rows, str(tmp_path / "done"), "id")
    assert spark.read.parquet(str(tmp_path / "done")).count() == 2
    assert sinks.unfinished(rows, str(tmp_path / "done"), "id").count() == 0


def test_markdown_files(spark, tmp_path):
    rows = spark.createDataFrame([("a b.pdf", "# é\ntext"), ("bad.pdf", None)], "file_name string, text string")
    sinks.markdown(rows, f"file://{tmp_path}/md")
    assert [p.name for p in (tmp_path / "md").glob("*.md")] == ["a b.md"]
    assert [tuple(r) for r in readers.markdown(spark, f"file://{tmp_path}/md").collect()] == [("a b.md", "a b", "# é\ntext")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
    Context.master = "local[3]"
    assert scratch.shared_dir(Session()).startswith("file://")


def test_stream_chunks_new_files_once(spark, tmp_path):
    docs = lambda i: spark.createDataFrame([(f"d{i}", "one\n\ntwo")], "name string, text string")
    run = lambda: ingest.chunk_new_files(
        spark, str(tmp_path / "in"), "name string, text string", F.col("name"), F.col("text"), str(tmp_path / "out"), str(tmp_path / "state")
    )
    docs(1).write.parquet(str(tmp_path / "in"))
    run()
    run()
    docs(2).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["doc_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["d1", "d2"]


def test_stream_indexes_new_files(spark, tmp_path):
    """Segments of arrivals answer like an index of all; a batch that is run again, and a document that comes again, add nothing."""
    texts = {i: f"alpha beta number{i}\n\n{'gamma ' * (i % 3)}delta" for i in range(12)}
    docs = lambda ids: spark.createDataFrame([(f"d{i}", texts[i]) for i in ids], "name string, text string")
    path, index = str(tmp_path / "in"), str(tmp_path / "index")
    run = lambda state="state": ingest.index_new_files(spark, path, "name string, text string", F.col("name"), F.col("text"), index, str(tmp_path / state))
    for ids in ([0, 1, 2, 3], [4, 5, 6], [6, 7, 8, 9, 10, 11]):
        docs(ids).coalesce(1).write.mode("append").parquet(path)
        run()
    run()
    held = postings.Index(spark, index)
    assert len(held.segments) == 3 and held.n_docs == 12
    run("another state")  # reads all files again
    assert postings.Index(spark, index).number == held.number
    asked = spark.createDataFrame([(1, "gamma number7"), (2, "delta")], "qid int, question string")
    rows = held.chunks().select("id", "ord", "pdf_name", "text")
    assert sorted(r["ord"] for r in rows.collect()) == list(range(12))
    want = sorted(map(tuple, bm25.topk(asked, rows, 4).collect()))
    assert sorted(map(tuple, postings.topk(asked, held, 4).collect())) == want
    ask.merge(spark, index)
    assert sorted(map(tuple, postings.topk(asked, ask.opened(spark, index), 4).collect())) == want


def test_entry_works_without_the_optional_part(monkeypatch):
    import __spark_entry__ as entry

    everything = set(entry.queries())
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("quarry.llm", "corpus_pipeline")) else find(name, *a))
    core = set(entry.queries())
    assert core <= everything and len(core) == 52 and set(entry.oracle_sql()) <= core
    assert "quarry.plans.queries" in sys.modules
