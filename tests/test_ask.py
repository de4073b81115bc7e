"""The way from an index to answers, and the chat client against a server of the test's own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarry.config import Settings
from quarry.operators import ask, generate


@pytest.fixture
def index(spark, tmp_path):
    rows = [(i, i, f"doc{i}", f"{word} stands here alone.") for i, word in enumerate(["insulin", "glucose", "exercise", "sleep", "diet", "water"])]
    ask.build(spark.createDataFrame(rows, "id long, ord long, pdf_name string, text string"), str(tmp_path / "index"))
    return str(tmp_path / "index")


def test_ask_reads_the_index_and_skips_blanks(spark, index):
    questions = spark.createDataFrame([(1, "What about sleep?"), (2, " \n "), (3, None)], "qid int, question string")
    got = ask.answers(questions, index, generate.ExtractiveGenerator()).collect()
    assert [(r["qid"], r["answer"]) for r in got] == [(1, "sleep stands here alone. [S1]")]
    sources = ask.prompted(questions, index).first()["sources"]
    assert [s["rank"] for s in sources] == [1, 2, 3, 4] and sources[0]["chunk_id"] == "3"
    with pytest.raises(FileNotFoundError, match="build it first"):
        ask.answers(questions, index + "-none", generate.ExtractiveGenerator())


class Chat(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, body))
        bad = "fail" in body["messages"][0]["content"]
        self.send_response(500 if bad else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": "yes [S1]"}}]}).encode())

    def log_message(self, *_):
        pass


def test_chat_generator():
    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    chat = generate.ChatGenerator(Settings(model="m", base_url=url, temperature=0.5, max_tokens=7), timeout=10)
    assert chat.answer("hello") == "yes [S1]"
    assert Chat.seen[0] == ("/v1/chat/completions", {"model": "m", "messages": [{"role": "user", "content": "hello"}], "temperature": 0.5, "max_tokens": 7})
    with pytest.raises(RuntimeError, match="500"):
        chat.answer("fail")
    server.shutdown()
    server.server_close()
    with pytest.raises(RuntimeError, match="no connection"):
        chat.answer("hello")


def test_chat_errors_stay_in_their_rows(spark):
    chat = generate.ChatGenerator(Settings(base_url="http://127.0.0.1:9/v1"), timeout=2)
    prompts = spark.createDataFrame([(1, "p")], "qid int, prompt string")
    assert generate.answers(prompts, chat, on_error="inline").first()["answer"].startswith("ERROR: no connection")
    assert generate.answers(prompts, chat, on_error="skip").count() == 0
