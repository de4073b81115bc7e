"""Chunking against a plain model of its rules."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import chunking
from quarry.functions.text import count_of, newlines, strip, tokens

TINY = Settings(max_chars=20, overlap=5)


def model(text, separator="\n\n", size=800, overlap=100):
    pieces = []
    for p in (x.strip() for x in text.split(separator)):
        if p and len(p) <= size:
            pieces.append(p)
        elif p:
            starts = [0]
            while starts[-1] + size < len(p):
                starts.append(starts[-1] + size - overlap)
            pieces += [w for w in (p[s : s + size].strip() for s in starts) if w]
    out = []
    for piece in pieces:
        if out and len(out[-1]) + 2 + len(piece) <= size:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
    return out


def run(spark, texts, separator="\n\n", size=Settings()):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, text string")
    rows = chunking.chunks(docs, F.col("name"), F.col("text"), separator, size).collect()
    out = {str(i): {} for i in range(len(texts))}
    for r in rows:
        digest = hashlib.sha1(f"{r['doc_name']}\n{r['text']}".encode()).hexdigest()[:20]
        assert r["id"] == f"{r['doc_name']}_chunk_{r['chunk_num']:04d}_{digest}"
        out[r["doc_name"]][r["chunk_num"]] = r["text"]
    return [[found[k] for k in sorted(found)] for found in out.values()]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab é\n\t\xa0😀.", max_size=120), min_size=10, max_size=25))
def test_packing_equals_model(spark, texts):
    assert run(spark, texts, "\n", TINY) == [model(t, "\n", 20, 5) for t in texts]


def test_default_sizes(spark):
    texts = ["", " \xa0 ", "a" * 800, "a" * 801, "word " * 700, "x" * 1500 + "\n\n" + "y" * 90 + "\n\nz", " " * 900 + "q", ("p" * 390 + "\n\n") * 5]
    got = run(spark, texts)
    assert got == [model(t) for t in texts]
    assert all(0 < len(c) <= 800 for chunks in got for c in chunks)


def test_numbers_beyond_four_digits(spark):
    row = spark.range(1).select(chunking.chunk_id(F.lit("d"), F.lit(12345), F.lit("t")).alias("x")).first()
    assert row["x"].startswith("d_chunk_12345_")


def test_names_are_stripped(spark):
    docs = spark.createDataFrame([(" a guide ", "text")], "name string, text string")
    assert chunking.chunks(docs, F.col("name"), F.col("text")).first()["doc_name"] == "a guide"


def test_strip_takes_all_blanks(spark):
    blanks = [c for c in map(chr, range(0x3100)) if c.isspace()]
    rows = spark.createDataFrame([(f"{c}x{c}{c}",) for c in blanks] + [("​x",)], "t string")
    got = [r[0] for r in rows.select(strip(F.col("t"))).collect()]
    assert got == ["x"] * len(blanks) + ["​x"]


def test_tokens_counts_and_newlines(spark):
    texts = ["Ab-c 12é3", "İstanbul K ſ", "", "x|y||http http"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(tokens(F.col("t")), count_of(F.col("t"), "|"), count_of(F.col("t"), "http"), newlines(F.lit("a\r\nb\rc"))).collect()
    assert [list(r[0]) for r in got] == [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    assert [(r[1], r[2]) for r in got] == [(0, 0), (0, 0), (0, 0), (3, 2)] and got[0][3] == "a\nb\nc"
