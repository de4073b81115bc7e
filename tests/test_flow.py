"""Files in order, files from tasks, checks in the writing job, generation under faults."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import evaluate, generate, prompts
from quarry.sources import markdown_files, readers, sinks


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_lines_of_a_large_file_keep_their_places(spark, tmp_path, small_splits):
    want = [f"line {i} " + "é" * (i % 50) + ("\x0bmore" if i % 9 == 0 else "") for i in range(300)]
    (tmp_path / "b.txt").write_bytes("\r\n".join(want[:100]).encode())
    (tmp_path / "c.txt").write_bytes("\n".join(want[100:]).encode() + b"\n")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    got = sorted(map(tuple, readers.lines(spark, str(tmp_path)).collect()))
    assert [n for n, _ in got] == list(range(1, len(got) + 1))
    assert [v for _, v in got] == [x for line in want for x in line.split("\x0b")]


def test_a_large_transcript_is_cut_at_its_rules(spark, tmp_path, small_splits):
    blocks = [f"start {i}\n=== ANSWER ===\nanswer {i}\n\n=== SOURCES USED ===\n[S1] pdf=p chunk_id=c{i} :: {'x' * (i * 7 % 300)}...\n" for i in range(40)]
    text = ("=" * 80).join([b if i % 5 else "no mark here" for i, b in enumerate(blocks)]) + "=" * 80 + "\nbye"
    (tmp_path / "run.txt").write_text(text)
    got = sorted(map(tuple, evaluate.transcript_file(spark, str(tmp_path / "run.txt")).collect()))
    assert got == [(n, b.strip()) for n, b in enumerate((b for i, b in enumerate(blocks) if i % 5), 1)]
    whole = evaluate.transcript_blocks(readers.whole_text(spark, str(tmp_path / "run.txt"))).collect()
    assert got == sorted(map(tuple, whole))


def test_documents_are_numbered_by_file_name(spark, tmp_path):
    for name in ("b.md", "a b.md", "c.md"):
        (tmp_path / name).write_text(name)
    got = readers.corpus(spark, str(tmp_path)).orderBy("doc_no").collect()
    assert [(r["doc_no"], r["doc_name"]) for r in got] == [(0, "a b"), (1, "b"), (2, "c")]


def test_markdown_files_of_a_failed_job_go(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("d%03d.x.pdf", "id").alias("file_name"), F.lit("t").alias("text")).repartition(4)
    sinks.markdown(rows, str(tmp_path / "good"))
    assert sorted(p.name for p in (tmp_path / "good").iterdir()) == [f"d{i:03d}.x.md" for i in range(40)]
    failing = rows.withColumn("text", F.when(F.col("file_name") == "d017.x.pdf", F.raise_error(F.lit("broken"))).otherwise("t"))
    with pytest.raises(Exception, match="broken"):
        sinks.markdown(failing, str(tmp_path / "bad"))
    left = [str(p) for p in (tmp_path / "bad").rglob("*") if p.is_file()] if (tmp_path / "bad").exists() else []
    assert left == []


def test_a_failed_task_leaves_no_file(tmp_path):
    writer = markdown_files.MarkdownWriter(str(tmp_path / "out"))

    def rows():
        yield {"name": "one", "text": "1"}
        raise ValueError("lost")

    with pytest.raises(ValueError, match="lost"):
        writer.write(rows())
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    message = writer.write(iter([{"name": "two", "text": "é"}]))
    assert (tmp_path / "out" / "two.md").read_text() == "é" and message.n == 1
    writer.abort([message])
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_contexts_are_written_and_then_checked(spark, tmp_path):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "qid int, question string")
    frozen = spark.createDataFrame([(2, ["c", "zz", "a", "yy"]), (1, ["a", "a"])], "qid int, chunk_ids array<string>")
    chunks = spark.createDataFrame([("a", "p", "ta"), ("c", "r", "tc")], "id string, pdf_name string, text string")
    out = str(tmp_path / "contexts")
    with pytest.raises(evaluate.MissingChunks, match="2 chunk ids of 1 questions are unknown, the first is \\(2, 'zz'\\)") as error:
        evaluate.write_contexts(questions, frozen, chunks, out)
    assert error.value.report == {"n_contexts": 2, "n_sources": 4, "n_missing": 2, "n_short": 1, "first": (2, "zz")}
    got = {r["qid"]: [s["chunk_id"] for s in r["sources"]] for r in readers.jsonl(spark, out, readers.FROZEN_CONTEXTS).collect()}
    assert got == {1: ["a", "a"], 2: ["c", "a"]}
    whole = evaluate.write_contexts(questions, frozen.where("qid = 1"), chunks, out)
    assert whole == {"n_contexts": 1, "n_sources": 2, "n_missing": 0, "n_short": 0, "first": None}
    empty = evaluate.write_contexts(questions, frozen.limit(0), chunks, out)
    assert empty["n_contexts"] == empty["n_missing"] == 0


class Chat(BaseHTTPRequestHandler):
    asked: Counter = Counter()
    open_now, most = 0, 0
    lock = threading.Lock()

    def do_POST(self):
        kind = type(self)
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        with kind.lock:
            kind.asked[prompt] += 1
            kind.open_now += 1
            kind.most = max(kind.most, kind.open_now)
            n = kind.asked[prompt]
        time.sleep(3.0 if "stalls" in prompt and n == 1 else 0.03)
        with kind.lock:
            kind.open_now -= 1
        code = 503 if "busy" in prompt and n < 3 else 400 if "bad" in prompt else 200
        try:
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": prompt.upper()}}]}).encode())
        except OSError:
            pass  # who asked has given up

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Chat.asked, Chat.open_now, Chat.most = Counter(), 0, 0
    running = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield generate.ChatGenerator(Settings(base_url=f"http://127.0.0.1:{running.server_port}/v1"), timeout=1.0)
    running.shutdown()
    running.server_close()


def test_a_server_that_fails_and_stalls(spark, server):
    texts = [f"q{i} " + ("busy" if i == 3 else "stalls" if i == 5 else "bad" if i == 7 else "") for i in range(24)]
    rows = spark.createDataFrame(list(enumerate(texts)), "qid int, prompt string").coalesce(1)
    got = generate.answers(rows, generate.Retrying(server, tries=4, wait=0.01), on_error="inline", in_flight=6).collect()
    assert [r["qid"] for r in got] == list(range(24))  # in order
    assert [r["answer"] for r in got] == ["ERROR: the server answered 400" if "bad" in t else t.upper() for t in texts]
    assert Chat.asked[texts[3]] == 3 and Chat.asked[texts[5]] == 2 and Chat.asked[texts[7]] == 1
    assert 1 < Chat.most <= 6 + 1  # one more while a stalled request is given up
    with pytest.raises(generate.Unavailable):
        generate.Retrying(server, tries=2, wait=0.01).answer("always busy")


def test_requests_keep_their_distance(server):
    began = time.monotonic()
    paced = generate.Retrying(server, rate=50)
    for i in range(6):
        paced.answer(f"p{i}")
    assert time.monotonic() - began >= 5 / 50


class Dying:
    """Fails at some prompts until a file is there; the file's folder counts what is asked."""

    model = "dying"

    def __init__(self, folder):
        self.folder = folder

    def answer(self, prompt):
        with open(f"{self.folder}/asked", "a") as out:
            out.write(prompt + "\n")
        import os

        if prompt == "p7" and not os.path.exists(f"{self.folder}/up"):
            raise RuntimeError("down")
        return prompt.upper()


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "qid int, prompt string")
    path = str(tmp_path / "answers")
    with pytest.raises(Exception, match="down"):
        generate.resumable(rows, Dying(str(tmp_path)), path, files=6, in_flight=1)
    committed = Counter()
    if (tmp_path / "answers" / "answers" / "_spark_metadata").exists():
        committed.update(r["answer"].lower() for r in spark.read.parquet(f"{path}/answers").collect())
    (tmp_path / "up").write_text("")
    more = rows.union(spark.createDataFrame([(50, "p50")], rows.schema))
    got = generate.resumable(more, Dying(str(tmp_path)), path, files=6, in_flight=1)
    assert sorted((r["qid"], r["answer"]) for r in got.collect()) == sorted((q, p.upper()) for q, p in more.collect())
    asked = Counter((tmp_path / "asked").read_text().split())
    assert set(asked) == {p for _, p in more.collect()}
    assert all(asked[p] == 1 for p in committed)  # what was finished is asked once
    before = sum(asked.values())
    assert generate.resumable(more, Dying(str(tmp_path)), path).count() == 13
    assert len((tmp_path / "asked").read_text().split()) == before  # nothing is left to ask


def test_sanity_generation(spark):
    class Echo:
        model = "echo"

        def answer(self, prompt):
            assert prompt.endswith("\n\nANSWER:\n") and "<END_ANSWER>" not in prompt
            return " so it is \n[S2] rest"

    text = prompts.training_text(F.lit("q"), prompts.raft_input(F.lit("o"), F.array(F.lit("d"))), F.lit("a"))
    got = generate.sanity(spark.range(2).select(F.col("id").alias("draw"), text.alias("text")), Echo()).collect()
    assert [(r["draw"], r["model"], r["answer"]) for r in got] == [(0, "echo", "so it is"), (1, "echo", "so it is")]
