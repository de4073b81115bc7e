"""Gates, samples, generated text, questions, transcripts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import answers
from quarry.operators import evaluate, gates, generate, prompts, sampling


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


def test_fences_and_fields(spark):
    texts = ["```json\n{}\n```", " ``` {} ``` ", "{}", "```JSON {}```", "```", "``````", "```json```", "x```", "\xa0```json  a```\n"]

    def model(s):
        s = s.strip()
        s = s[7:].strip() if s.startswith("```json") else s[3:].strip() if s.startswith("```") else s
        return s[:-3].strip() if s.endswith("```") else s

    assert column(spark, texts, answers.without_fences) == [model(t) for t in texts]
    texts = ['{"q": " a "}', "{}", "[]", '{"q": 1}', '{"q": null}', "{'q': 'a'}", '{"q": "a"} x', "", "nonsense", '{"q": "a"}, {"q": "b"}', '"q"', '{"q": {"q": "a"}}']
    assert column(spark, texts, lambda t: answers.json_field(t, "q")) == ["a", ""] + [None] * 10


def test_truncation_and_citation(spark):
    assert column(spark, ["a <END_ANSWER> b", "a\n---\nb", " a\n[S2] b\n[S3]", "a [S2]", "\n[S4]"], answers.truncated) == ["a", "a", "a", "a [S2]", ""]
    assert column(spark, ["a ", "a [S1] b"], answers.cited) == ["a [S1]", "a [S1] b"]


def test_gates(spark):
    long = "plain words about dosage " * 8
    bad = [long[:100], long + mark if (mark := "REFERENCES") else "", long + " et al.", long + "|" * 13, long + "http http"]
    assert column(spark, [long, long + "|" * 12 + "http", *bad], gates.good_passage) == [True, True] + [False] * 5
    pairs = [("What is the first dose of it?", "Twelve units."), ("Too short?", "Twelve units."), ("What is the first dose of it?", "short"),
             ("Who chaired the meeting in it?", "Twelve units."), ("What is the first dose of it?", "See recommendation 4")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, a string").orderBy("i")
    assert [r[0] for r in rows.select(gates.good_pair(F.col("q"), F.col("a"))).collect()] == [True, False, False, False, False]


def test_samples(spark):
    pool = spark.createDataFrame([(i, f"g{i % 4}") for i in range(200)], "id long, group string")
    size = Settings(oracles=60)
    draws = sampling.with_replacement(pool, settings=size)
    first = sorted(draws.collect())
    assert [r["draw"] for r in first] == list(range(60)) and len({r["id"] for r in first}) > 30
    assert first == sorted(sampling.with_replacement(pool.repartition(7), settings=size).collect())
    got = sampling.distractors(draws, pool, "group", settings=size).collect()
    assert len(got) == 180 and len({(r["draw"], r["id"]) for r in got}) == 180
    assert all(r["id"] % 4 != r["oracle"] % 4 for r in got)
    one = pool.where("id < 4").withColumn("group", F.when(F.col("id") == 3, "b").otherwise("a"))
    got = sampling.distractors(sampling.with_replacement(one, settings=size), one, "group", settings=size).collect()
    assert len(got) == 180 and all(r["id"] != r["oracle"] for r in got)
    few = pool.where("id < 3")
    with pytest.raises(Exception, match="too few passages"):
        sampling.distractors(sampling.with_replacement(few, settings=size), few, "group", settings=size).collect()


def test_raft_round_trip(spark):
    rows = spark.createDataFrame([("oracle text", ["d one", "d two", "d three"])], "o string, ds array<string>")
    oracle, others = prompts.raft_split(F.col("x"))
    got = rows.select(prompts.raft_input(F.col("o"), F.col("ds")).alias("x")).select(oracle, others, prompts.training_text(F.lit(" q "), F.col("x"), F.lit("a "))).first()
    assert got[0] == "oracle text" and list(got[1]) == ["d one", "d two", "d three"]
    assert got[2].startswith("You are a medical document QA assistant.\nRULES:\n") and got[2].endswith("\n\nANSWER:\na [S1]\n<END_ANSWER>")
    assert "\n\n---\n\n[S4] pdf=distractor_doc chunk_id=distractor_chunk_3\nd three" in got[2]
    assert column(spark, [" Context (oracle): all of it "], lambda t: prompts.raft_split(t)[0]) == ["all of it"]


def test_prompts_differ_where_they_should(spark):
    rows = spark.createDataFrame([("q", [("c1", "p 1", "t1"), ("c2", "p2", "t2")])], "q string, s array<struct<chunk_id string, pdf_name string, text string>>")
    made = {k: rows.select(prompts.question_prompt(k, F.col("q"), F.col("s"))).first()[0] for k in ("ui", "cli", "local", "hosted")}
    assert made["hosted"].replace("factual.\n\n\n", "factual.\n\n") == made["local"]
    assert all(m.endswith("\n\nQUESTION:\nq\n\nSOURCES:\n[S1] pdf=p 1 chunk_id=c1\nt1\n\n---\n\n[S2] pdf=p2 chunk_id=c2\nt2\n") for m in made.values())


def test_questions(spark):
    lines = ["1. first", " 2 . second. part ", "no number", "", "x. y", "1. again", "3.", "². odd"]
    rows = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "line_no int, value string")
    assert sorted(tuple(r) for r in evaluate.questions_strict(rows).collect()) == [(1, "again"), (2, "second. part"), (3, "")]
    lenient = [tuple(r)[1:] for r in evaluate.questions_lenient(rows).orderBy("pos").collect()]
    assert lenient == [(1, "first"), (2, "second. part"), (3, "no number"), (4, "x. y"), (1, "again"), (3, ""), (7, "². odd")]


def test_frozen_contexts(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "qid int, question string")
    frozen = spark.createDataFrame([(2, ["c", "a", "zz"]), (1, ["a", "a"])], "qid int, chunk_ids array<string>")
    chunks = spark.createDataFrame([("a", "p", "old", 1), ("a", "p", "new", 2), ("c", "r", "tc", 3)], "id string, pdf_name string, text string, ord int")
    got = {r["qid"]: [tuple(s) for s in r["sources"]] for r in evaluate.frozen_contexts(questions, frozen, chunks).collect()}
    assert got == {1: [("a", "p", "new")] * 2, 2: [("c", "r", "tc"), ("a", "p", "new")]}
    assert [tuple(r) for r in evaluate.missing_chunks(frozen, chunks).collect()] == [(2, "zz")]
    with pytest.raises(Exception, match="no question"):
        evaluate.frozen_contexts(questions.where("qid = 1"), frozen, chunks).collect()


def test_transcript_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"answer {i}\nwith lines", [(f"c {j}", f"my doc {j}", "t" * rng.randint(1, 400) + " :: \nx") for j in range(i)]) for i in range(4)]
    table = spark.createDataFrame(rows, "i int, answer string, s array<struct<chunk_id string, pdf_name string, text string>>")
    shown = table.select("i", evaluate.render_transcript(F.col("answer"), F.col("s")).alias("t")).orderBy("i").collect()
    run = spark.createDataFrame([("Loading...\n" + "".join(r["t"] for r in shown) + "bye\n",)], "text string")
    questions = spark.createDataFrame([(i + 1, i + 1, f"q{i}") for i in range(4)], "pos int, qid int, question string")
    got = evaluate.parse_transcript(run, questions).orderBy("qid").collect()
    for (_, answer, sources), r in zip(rows, got, strict=True):
        assert r["answer"] == answer
        assert [(s["label"], s["chunk_id"], s["pdf_name"], s["snippet"]) for s in r["sources_used"]] == [
            (f"[S{n}]"[1:-1], c, p, t.replace("\n", " ")[:220] + "...") for n, (c, p, t) in enumerate(sources, 1)
        ]
    more = spark.createDataFrame([(5, 5, "q5")], questions.schema)
    for unequal in (questions.where("pos < 4"), questions.unionByName(more)):
        with pytest.raises(Exception, match="differ in number"):
            evaluate.parse_transcript(run, unequal).collect()
    alone = spark.createDataFrame([("=== ANSWER ===\nno sources",)], "block string")
    answer, sources = evaluate.parsed_block(F.col("block"))
    assert tuple(alone.select(answer, F.size(sources)).first()) == ("", 0)


class Failing:
    model = "failing"

    def answer(self, prompt):
        if "bad" in prompt:
            raise ValueError("down")
        return prompt.upper()


def test_generation_policies(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "qid int, prompt string")
    run = lambda policy: {r["qid"]: r["answer"] for r in generate.answers(rows, Failing(), on_error=policy).collect()}
    assert run("skip") == {1: "OK", 3: ""}
    assert run("inline") == {1: "OK", 2: "ERROR: down", 3: ""}
    with pytest.raises(Exception, match="down"):
        run("raise")
    with pytest.raises(ValueError):
        generate.answers(rows, Failing(), on_error="other")


def test_extractive_answers():
    prompt = "RULES\n\nQUESTION:\nfirst line drug?\n\nSOURCES:\n[S1] pdf=a chunk_id=b\nNothing here.\n\n---\n\n[S2] pdf=a chunk_id=c\nWell. The first line drug is X.\n"
    assert generate.ExtractiveGenerator().answer(prompt) == "The first line drug is X. [S2]"
    assert generate.ExtractiveGenerator().answer("QUESTION:\nzz\n\nSOURCES:\n[S1] pdf=a\nb") == prompts.UNKNOWN


def test_rubric_and_settings(spark):
    rows = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", None, True)], "s string, correct boolean, grounded boolean")
    assert sorted(tuple(r) for r in evaluate.score_rubric(rows, "s").collect()) == [("a", 1, 2), ("b", 0, 1)]
    assert Settings.from_env({"QUARRY_MODEL": " m ", "QUARRY_TEMPERATURE": "0.5"}).temperature == 0.5
    assert json.dumps(Settings().k_sem) == "4"
