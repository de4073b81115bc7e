"""Evaluation data: questions, frozen contexts, transcripts, rubric scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.functions.text import LINE_BREAK, after, before, strip
from quarry.operators.order import numbered
from quarry.sources import readers, sinks

#: The layout of a transcript.
BLOCK_RULE = "=" * 80
ANSWER_MARK, SOURCES_MARK = "=== ANSWER ===", "=== SOURCES USED ==="
SOURCE_LINE = r"^\[(S\d+)\]\s+pdf=(.*?)\s+chunk_id=(.*?)\s+::\s+(.*)$"
NUMBERED = r"^\s*(\d+)\s*\.(.*)$"


def dedupe_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that comes last, as a later entry of a lookup table replaces an earlier one."""
    others = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r"))
    return last.select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def _numbered(lines: DataFrame) -> DataFrame:
    """line_no, number (null if the line has none), rest, without blank lines."""
    text = strip(F.col("value"))
    found = F.regexp_extract(text, NUMBERED, 1)
    return (
        lines.select("line_no", text.alias("text"), F.when(found != "", found.cast("int")).alias("number"))
        .where("text <> ''")
        .withColumn("rest", F.when(F.col("number").isNotNull(), strip(F.regexp_extract("text", NUMBERED, 2))))
    )


def questions_strict(lines: DataFrame) -> DataFrame:
    """qid, question of numbered lines (line_no, value); other lines are ignored, of a number's lines the last counts."""
    rows = _numbered(lines).where("number is not null")
    return dedupe_last(rows.select("line_no", F.col("number").alias("qid"), F.col("rest").alias("question")), "qid", "line_no")


def questions_lenient(lines: DataFrame) -> DataFrame:
    """pos, qid, question of all lines in order; an unnumbered line's number is its position, duplicates stay."""
    rows = numbered(_numbered(lines), ["line_no"], "pos", start=1).withColumn("pos", F.col("pos").cast("int"))
    return rows.select("pos", F.coalesce("number", "pos").alias("qid"), F.coalesce("rest", "text").alias("question"))


def _asked(frozen: DataFrame) -> DataFrame:
    return frozen.select("qid", F.posexplode("chunk_ids").alias("pos", "chunk_id"))


def frozen_contexts(questions: DataFrame, frozen: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, question, sources in their order, for frozen (qid, chunk_ids) and chunks (id, pdf_name, text).

    A number without a question is an error; unknown chunks drop out. Repeated ids and numbers count by their
    last row, given by `ord` where the table has it.
    """
    return _contexts(questions, frozen, chunks).drop("missing")


def _contexts(questions: DataFrame, frozen: DataFrame, chunks: DataFrame) -> DataFrame:
    """frozen_contexts with missing, the ids that no chunk has."""
    known = dedupe_last(chunks, "id", "ord") if "ord" in chunks.columns else chunks
    known = known.select(F.col("id").alias("chunk_id"), F.lit(True).alias("known"), "pdf_name", "text")
    found = _asked(frozen).join(known, "chunk_id", "left")
    found = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "pdf_name", "text", "known"))).alias("s"))
    sources = F.transform(F.filter("s", lambda x: x["known"].isNotNull()), lambda x: F.struct(x["chunk_id"], x["pdf_name"], x["text"]))
    missing = F.transform(F.filter("s", lambda x: x["known"].isNull()), lambda x: x["chunk_id"])
    rows = frozen.select("qid").join(questions, "qid", "left").join(found.select("qid", sources.alias("sources"), missing.alias("missing")), "qid", "left")
    failed = F.raise_error(F.concat(F.lit("no question for number "), F.col("qid").cast("string")))
    question = F.when(F.coalesce("question", F.lit("")) == "", failed).otherwise(F.col("question"))
    return rows.select("qid", question.alias("question"), *(F.coalesce(c, F.array()).alias(c) for c in ("sources", "missing")))


class MissingChunks(ValueError):
    """Frozen ids that no chunk has; what could be written is written. report holds the counts."""

    def __init__(self, report: dict):
        super().__init__(f"{report['n_missing']} chunk ids of {report['n_short']} questions are unknown, the first is {report['first']}")
        self.report = report


def write_contexts(questions: DataFrame, frozen: DataFrame, chunks: DataFrame, path: str, strict: bool = True) -> dict:
    """Write frozen_contexts as JSON lines and count in the same job what is missing: n_contexts, n_sources, n_missing, n_short and
    first (number and id of the first one that is missing, null for none).

    The output is complete first; then, if strict, missing chunks are an error. missing_chunks lists all of them.
    """
    seen = Observation()
    size = lambda c: F.sum(F.size(c))
    first = F.min(F.when(F.size("missing") > 0, F.struct("qid", F.try_element_at("missing", F.lit(1)).alias("chunk_id"))))
    rows = _contexts(questions, frozen, chunks).observe(
        seen, F.count("*").alias("n_contexts"), size("sources").alias("n_sources"), size("missing").alias("n_missing"),
        F.count_if(F.size("missing") > 0).alias("n_short"), first["qid"].alias("first_qid"), first["chunk_id"].alias("first_id"),
    )
    sinks.jsonl(rows.drop("missing"), path, single=False)
    found = seen.get
    report = {n: found[n] or 0 for n in ("n_contexts", "n_sources", "n_missing", "n_short")}
    report["first"] = (found["first_qid"], found["first_id"]) if report["n_missing"] else None
    if strict and report["n_missing"]:
        raise MissingChunks(report)
    return report


def missing_chunks(frozen: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, chunk_id of frozen ids that no chunk has."""
    known = chunks.select(F.col("id").alias("chunk_id"))
    return _asked(frozen).join(known, "chunk_id", "left_anti").select("qid", "chunk_id")


def snippet(text: Column, size: int = DEFAULT.snippet_chars) -> Column:
    return F.concat(F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, size), F.lit("..."))


def render_transcript(answer: Column, sources: Column) -> Column:
    """An answer and its sources (chunk_id, pdf_name, text) as they are shown, with the rule that ends a block."""
    lines = F.transform(
        sources,
        lambda s, i: F.concat(
            F.lit("[S"), (i + 1).cast("string"), F.lit("] pdf="), s["pdf_name"], F.lit(" chunk_id="), s["chunk_id"], F.lit(" :: "), snippet(s["text"]), F.lit("\n")
        ),
    )
    return F.concat(F.lit(f"\n{ANSWER_MARK}\n"), answer, F.lit(f"\n\n{SOURCES_MARK}\n"), F.array_join(lines, ""), F.lit(BLOCK_RULE + "\n"))


def transcript_blocks(runs: DataFrame, keep: tuple = ()) -> DataFrame:
    """keep, block_no (from 1), block of each text's blocks that hold an answer."""
    blocks = F.filter(F.split("text", BLOCK_RULE, -1), lambda b: F.contains(b, F.lit(ANSWER_MARK)))
    return runs.select(*keep, F.posexplode(F.transform(blocks, strip)).alias("pos", "block")).select(
        *keep, (F.col("pos") + 1).alias("block_no"), "block"
    )


def transcript_file(spark: SparkSession, path: str) -> DataFrame:
    """block_no (from 1), block of a transcript's blocks that hold an answer; a large file is cut at the rules between them."""
    found = readers.parts(spark, path, BLOCK_RULE, F.contains(F.col("value"), F.lit(ANSWER_MARK)))
    return found.select(F.col("part_no").alias("block_no"), strip(F.col("value")).alias("block"))


def parsed_block(block: Column) -> tuple[Column, Column]:
    """Answer and sources (label, chunk_id, pdf_name, snippet) of a block; without the second mark neither."""
    both = F.contains(block, F.lit(SOURCES_MARK))
    answer = F.when(both, strip(before(after(block, ANSWER_MARK), SOURCES_MARK))).otherwise("")
    lines = F.transform(F.split(strip(after(block, SOURCES_MARK)), LINE_BREAK, -1), strip)
    sources = F.transform(
        F.filter(lines, lambda x: F.rlike(x, F.lit(SOURCE_LINE))),
        lambda x: F.struct(
            *(
                F.regexp_extract(x, SOURCE_LINE, n).alias(c)
                for n, c in ((1, "label"), (3, "chunk_id"), (2, "pdf_name"), (4, "snippet"))
            )
        ),
    )
    return answer, sources


def parse_transcript(runs: DataFrame, questions: DataFrame, keep: tuple = ()) -> DataFrame:
    """keep, qid, question, answer, sources_used: the n-th block of a text belongs to the n-th question (keep, pos, qid, question).

    A block without a question, or a question without a block, is an error.
    """
    answer, sources = parsed_block(F.col("block"))
    blocks = transcript_blocks(runs, keep).withColumnRenamed("block_no", "pos")
    both = blocks.select(*keep, "pos", F.lit(True).alias("has_block"), answer.alias("answer"), sources.alias("sources_used")).join(
        questions.select(*keep, "pos", F.lit(True).alias("has_question"), "qid", "question"), [*keep, "pos"], "full_outer"
    )
    failed = F.raise_error(F.concat(F.lit("blocks and questions differ in number at "), F.col("pos").cast("string")))
    answer = F.when(F.col("has_block") & F.col("has_question"), F.col("answer")).otherwise(failed)
    return both.select(*keep, "qid", "question", answer.alias("answer"), "sources_used")


def score_rubric(graded: DataFrame, by: str) -> DataFrame:
    """by, points, out_of: a point for each answer that is correct and grounded."""
    point = (F.coalesce("correct", F.lit(False)) & F.coalesce("grounded", F.lit(False))).cast("int")
    return graded.groupBy(by).agg(F.sum(point).alias("points"), F.count("*").alias("out_of"))
