"""Generation behind an interface: a batch of prompts in, answers out, with three error policies."""

from __future__ import annotations

import json
import re
import threading
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Settings
from quarry.functions.answers import truncated
from quarry.functions.text import before
from quarry.operators.prompts import UNKNOWN
from quarry.sources import sinks

ANSWER = "\n\nANSWER:\n"

POLICIES = ("raise", "skip", "inline")
_TOKEN = re.compile("[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


#: Answers of a server that may be other ones later.
BUSY = (408, 425, 429, 500, 502, 503, 504)


class Unavailable(RuntimeError):
    """The server can't answer now."""


class Generator(Protocol):
    """Answers a prompt; raises if it can't."""

    model: str

    def answer(self, prompt: str) -> str: ...


class ExtractiveGenerator:
    """Offline stand-in: the sentence of the sources that shares most distinct tokens with the question, cited."""

    model = "extractive"

    def answer(self, prompt: str) -> str:
        head, _, rest = prompt.partition("\n\nSOURCES:\n")
        question = set(_TOKEN.findall(head.rpartition("QUESTION:\n")[2].lower()))
        best = (0, "", "")
        for block in re.split(r"\n\n---\n\n(?=\[S\d+\] )", rest):
            label, _, text = block.partition("\n")
            label = label.partition(" ")[0]
            for sentence in _SENTENCE.split(text):
                shared = len(question & set(_TOKEN.findall(sentence.lower())))
                if shared > best[0]:
                    best = (shared, sentence.strip(), label)
        return f"{best[1]} {best[2]}" if best[0] else UNKNOWN


class ChatGenerator:
    """A chat server that speaks the common completions protocol over HTTP: one message in, its answer out.

    Errors of the connection and of the server are raised, and the policy of `answers` decides what becomes of them.
    """

    def __init__(self, settings: Settings = DEFAULT, timeout: float = 60.0, key: str = "local"):
        self.model, self.timeout, self.key = settings.model, timeout, key
        self.url = settings.base_url.rstrip("/") + "/chat/completions"
        self.options = {"temperature": settings.temperature, "max_tokens": settings.max_tokens}

    def answer(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.options}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                found = json.load(reply)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as error:
            kind = Unavailable if error.code in BUSY else RuntimeError
            raise kind(f"the server answered {error.code}") from error
        except OSError as error:  # a stalled server too
            raise Unavailable(f"no connection to {self.url}") from error
        return found or ""


class Retrying:
    """A generator that asks again, after waits that double, while the server is unavailable; other errors are raised at once.

    rate bounds the requests that begin in a second, over all threads of a task.
    """

    def __init__(self, inner: Generator, tries: int = 4, wait: float = 0.5, longest: float = 30.0, rate: float | None = None):
        self.inner, self.model = inner, inner.model
        self.tries, self.wait, self.longest, self.rate = tries, wait, longest, rate

    def answer(self, prompt: str) -> str:
        wait = self.wait
        for left in range(self.tries - 1, -1, -1):
            _paced(self.rate)
            try:
                return self.inner.answer(prompt)
            except Unavailable:
                if not left:
                    raise
            time.sleep(min(wait, self.longest))
            wait *= 2
        raise ValueError("tries must be 1 or more")


_pace, _next = threading.Lock(), [0.0]


def _paced(rate: float | None) -> None:
    """Wait for this request's turn: in a process turns are 1 / rate seconds apart."""
    if rate:
        with _pace:
            turn = max(_next[0], time.monotonic())
            _next[0] = turn + 1 / rate
        time.sleep(max(0.0, turn - time.monotonic()))


def answers(
    prompts: DataFrame, generator: Generator, prompt_col: str = "prompt", keep: tuple = ("qid",), on_error: str = "raise", in_flight: int = 1
) -> DataFrame:
    """The columns of keep, model, answer. A failing row fails the job (raise), is left out (skip), or has the error as its answer (inline).

    in_flight requests of a task are under way at a time; rows keep their order.
    """
    if on_error not in POLICIES:
        raise ValueError(f"on_error must be one of {POLICIES}")

    def one(prompt: str | None) -> tuple[bool, str]:
        try:
            return True, generator.answer(prompt or "")
        except Exception as error:
            if on_error == "raise":
                raise
            return on_error == "inline", f"ERROR: {error}"

    def run(batches):
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                # A bounded number of prompts waits for the pool.
                for start in range(0, batch.num_rows, 16 * in_flight):
                    part = batch.slice(start, 16 * in_flight)
                    given = part.column(0).to_pylist()
                    found = list(pool.map(one, given)) if in_flight > 1 else [one(p) for p in given]
                    take = pa.array([i for i, (good, _) in enumerate(found) if good], pa.int64())
                    texts = pa.array([x for good, x in found if good], pa.string())
                    names = [*keep, "model", "answer"]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(take) for c in part.columns[1:]), pa.array([generator.model] * len(texts), pa.string()), texts], names
                    )

    kinds = "".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}, " for c in keep)
    return prompts.select(prompt_col, *keep).mapInArrow(run, f"{kinds}model string, answer string")


def resumable(
    prompts: DataFrame, generator: Generator, path: str, key: str = "qid", files: int = 16, on_error: str = "raise", in_flight: int = 4
) -> DataFrame:
    """key, model, answer of all prompts (key, prompt) that were ever given for a path, each asked once when it is finished.

    Prompts that the path doesn't know yet are kept there in `files` files, and a stream reads one of them for each micro-batch and appends its
    answers, which are committed as a whole. A run that breaks off loses the open micro-batch only: the next call goes on after the last one
    committed. With skip, a prompt without an answer is finished too. Keys are unique and not null.
    """
    spark = prompts.sparkSession
    asked = prompts.select(F.col(key), F.col("prompt"))
    source, target, state = (f"{path.rstrip('/')}/{n}" for n in ("prompts", "answers", "state"))
    fresh = sinks.unfinished(asked, source, key)
    # Written before the stream starts; if this breaks off, the next call adds what is missing.
    fresh.repartition(files, key).write.mode("append").parquet(source)
    rows = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        answers(rows, generator, keep=(key,), on_error=on_error, in_flight=in_flight)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(f"`{key}` {asked.schema[key].dataType.simpleString()}, model string, answer string").parquet(target)


def sanity(texts: DataFrame, generator: Generator, text: str = "text", keep: tuple = ("draw",)) -> DataFrame:
    """The columns of keep, model, answer: what a model makes of training texts (training_text) up to the answer, cut at the first stop marker."""
    asked = texts.select(*keep, F.concat(before(F.col(text), ANSWER), F.lit(ANSWER)).alias("prompt"))
    return answers(asked, generator, keep=keep).withColumn("answer", truncated(F.col("answer")))
