"""The registered queries: each operator over whole test tables.

Where a table stands in for another (benchmark items for questions, documents for chunks, conversation turns for
answers), the stand-in is made here, and the SQL in oracle.py makes the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.functions import answers as text_of
from quarry.functions import chunking
from quarry.functions.text import strip, tokens
from quarry.operators import approximate, ask, bm25, evaluate, fusion, gates, generate, lsa, nearest, postings, prompts, sampling, vectors
from quarry.sources import html, readers, sinks
from quarry.sources.scratch import Workspace, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "source", "text")


def _questions(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _chunks(spark, sf_dir, separator) -> DataFrame:
    return chunking.chunks(_table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), F.col("text"), separator)


def tokenize(spark, sf_dir):
    found = _table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def paragraphs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"), "\n")).alias("pos", "paragraph"))


def paragraph_windows(spark, sf_dir):
    found = paragraphs(spark, sf_dir)
    return found.select("doc_id", "pos", F.posexplode(chunking.windows(F.col("paragraph"))).alias("win", "piece"))


def chunk_pack(spark, sf_dir):
    return _chunks(spark, sf_dir, "\n").select("doc_name", "chunk_num", "text")


def chunk_ids(spark, sf_dir):
    return _chunks(spark, sf_dir, "\n\n").select("id", "doc_name", "chunk_num", "text")


def scan_chunks(spark, sf_dir):
    path = scratch(spark, "chunks")
    rows = _chunks(spark, sf_dir, "\n\n").select("id", F.col("doc_name").alias("pdf_name"), "text")
    sinks.jsonl(rows, path, single=False)
    return readers.jsonl(spark, path, readers.CHUNKS)


def corpus_profile(spark, sf_dir):
    return _chunks(spark, sf_dir, "\n").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(gates.good_passage(F.col("text"))).alias("n_usable"),
        F.sum(F.length("text")).alias("n_chars"),
        F.max(F.length("text")).cast("long").alias("longest"),
        F.countDistinct("doc_name").alias("n_docs"),
    )


def term_freq(spark, sf_dir):
    return bm25.term_freq(_corpus(spark, sf_dir)).select(F.col("id").alias("doc_id"), "term", "tf")


def term_stats(spark, sf_dir):
    return bm25.term_stats(_corpus(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    found = bm25.topk(_questions(spark, sf_dir), _corpus(spark, sf_dir))
    return found.select("qid", F.col("id").alias("doc_id"), "bm25_rank", "score")


def index_topk(spark, sf_dir):
    """The keyword index is built, and read by the questions."""
    path = scratch(spark, "index")
    postings.build(_corpus(spark, sf_dir), path, buckets=16)
    return _from_index(spark, sf_dir, path)


def _from_index(spark, sf_dir, path) -> DataFrame:
    found = postings.topk(_questions(spark, sf_dir), postings.Index(spark, path))
    return found.select("qid", F.col("id").alias("doc_id"), "bm25_rank", "score")


def index_segments(spark, sf_dir):
    """A base and three segments that are appended hold all documents between them."""
    path, docs = scratch(spark, "index"), _corpus(spark, sf_dir)
    part = F.pmod(F.xxhash64("id"), F.lit(4))
    postings.build(docs.where(part == 0), path, buckets=16)
    for i in (1, 2, 3):
        postings.append(docs.where(part == i), path)
    return _from_index(spark, sf_dir, path)


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "embeddings")
    vector = F.col("embedding").cast("array<double>").alias("vector")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), vector)
    return asked, rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), vector)


def ann_topk(spark, sf_dir):
    """The approximate index is built, and read by every vector whose number 20 divides."""
    path = scratch(spark, "ann")
    asked, corpus = _vectors(spark, sf_dir)
    approximate.build(corpus, path)
    found = approximate.topk(asked, approximate.Index(spark, path))
    return found.select("qid", F.col("id").alias("vec_id"), "sem_rank", F.round("distance", 5).alias("distance"))


def vector_topk(spark, sf_dir):
    found = nearest.topk(*_vectors(spark, sf_dir))
    return found.select("qid", F.col("id").alias("vec_id"), "sem_rank", F.round("distance", 5).alias("distance"))


def hash_embed(spark, sf_dir):
    found = vectors.embed(_questions(spark, sf_dir), vectors.HashingEmbedder(), "qid", "question")
    cells = found.select("qid", F.posexplode("vector").alias("bucket", "weight"))
    return cells.where("weight <> 0").select("qid", "bucket", F.round("weight", 6).alias("weight"))


def rrf_fuse(spark, sf_dir):
    found = fusion.hybrid(_questions(spark, sf_dir), _corpus(spark, sf_dir))
    return found.select("qid", F.col("id").alias("doc_id"), "sem_rank", "bm25_rank", F.round("score", 9).alias("score"), "rank")


def _retrieved(spark, sf_dir) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return fusion.with_texts(fusion.hybrid(_questions(spark, sf_dir), corpus), corpus, ("source", "text"))


def hybrid_topk(spark, sf_dir):
    return _retrieved(spark, sf_dir).select("qid", "rank", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "text")


def _with_sources(spark, sf_dir) -> DataFrame:
    source = F.struct("rank", F.col("id").cast("string").alias("chunk_id"), F.col("source").alias("pdf_name"), "text")
    found = _retrieved(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    return found.join(_questions(spark, sf_dir), "qid")


def build_prompt(spark, sf_dir):
    found = _with_sources(spark, sf_dir)
    made = [prompts.question_prompt(k, F.col("question"), F.col("sources")).alias(f"prompt_{k}") for k in ("ui", "cli", "local", "hosted")]
    return found.select("qid", *made)


def answers_extractive(spark, sf_dir):
    """The index is built, and read by the questions."""
    path = scratch(spark, "index")
    ask.build(_corpus(spark, sf_dir).withColumnRenamed("source", "pdf_name"), path)
    return ask.answers(_questions(spark, sf_dir), path, generate.ExtractiveGenerator()).drop("question")


def answers_resumable(spark, sf_dir):
    """The first call gets half of the questions, the second all; each is asked once."""
    index, path = scratch(spark, "index"), scratch(spark, "answers")
    ask.build(_corpus(spark, sf_dir).withColumnRenamed("source", "pdf_name"), index)
    # Written once, as both calls read them.
    asked = Workspace(spark).written(ask.prompted(_questions(spark, sf_dir), index).select("qid", "prompt"), "prompts")
    half = F.pmod(F.xxhash64("qid"), F.lit(2)) == 0
    generate.resumable(asked.where(half), generate.ExtractiveGenerator(), path, files=2)
    return generate.resumable(asked, generate.ExtractiveGenerator(), path, files=2)


def sanity_answers(spark, sf_dir):
    text = prompts.training_text(F.col("instruction"), F.col("input"), F.col("output"))
    return generate.sanity(_raft(spark, sf_dir).select("draw", text.alias("text")), generate.ExtractiveGenerator())


def questions_asked(spark, sf_dir):
    """Questions of which every third is blank and every seventh null."""
    number = F.col("qid")
    rows = _questions(spark, sf_dir).select("qid", F.when(number % 7 == 2, F.lit(None)).when(number % 3 == 1, F.lit(" \n\t ")).otherwise(F.col("question")).alias("question"))
    return ask.asked(rows)


def oracle_gate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", gates.good_passage(F.col("text")).alias("good"))


def _usable(spark, sf_dir) -> DataFrame:
    """id, source of the passages that pass the gate; written once, as draws look at them several times."""
    path = scratch(spark, "usable")
    _corpus(spark, sf_dir).where(gates.good_passage(F.col("text"))).select("id", "source").write.parquet(path)
    return spark.read.schema("id bigint, source string").parquet(path)


def oracle_sample(spark, sf_dir):
    return sampling.with_replacement(_usable(spark, sf_dir)).select("draw", F.col("id").alias("doc_id"))


def _sampled(spark, sf_dir) -> DataFrame:
    pool = _usable(spark, sf_dir)
    return sampling.distractors(sampling.with_replacement(pool), pool, "source")


def distractor_sample(spark, sf_dir):
    return _sampled(spark, sf_dir).select("draw", F.col("oracle").alias("oracle_id"), "n", F.col("id").alias("doc_id"))


def _raft(spark, sf_dir) -> DataFrame:
    """draw, instruction, input, output: the benchmark's items in turn stand in for the questions, the passage for the answer."""
    path = scratch(spark, "sampled")
    _sampled(spark, sf_dir).write.parquet(path)
    sample = spark.read.schema("draw int, oracle bigint, n int, id bigint").parquet(path)
    texts = _corpus(spark, sf_dir).select("id", "text")
    wanted = sample.select("draw", F.lit(0).alias("n"), F.col("oracle").alias("id")).distinct().unionByName(sample.select("draw", "n", "id"))
    # A stated number of draws, with four passages each.
    held = texts.join(F.broadcast(wanted), "id").groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"))
    asked = _questions(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("qid", "question"))).alias("asked"))
    instruction = F.col("asked")[F.col("draw") % F.size("asked")]["question"]
    oracle = F.element_at("p", 1)["text"]
    others = F.transform(F.filter("p", lambda x: x["n"] > 0), lambda x: x["text"])
    return held.crossJoin(F.broadcast(asked)).select(  # one row, of the stated set of questions
        "draw", instruction.alias("instruction"), prompts.raft_input(oracle, others).alias("input"), oracle.alias("output"),
        prompts.generation_prompt(oracle, others).alias("prompt"),
    )


def raft_records(spark, sf_dir):
    return _raft(spark, sf_dir)


def raft_split(spark, sf_dir):
    oracle, others = prompts.raft_split(F.col("input"))
    found = _raft(spark, sf_dir).select("draw", oracle.alias("oracle"), others.alias("others"))
    return found.select("draw", "oracle", F.size("others").alias("n_others"), F.array_join("others", "\n|\n").alias("others"))


def sft_format(spark, sf_dir):
    text = prompts.training_text(F.col("instruction"), F.col("input"), F.col("output"))
    return _raft(spark, sf_dir).select("draw", text.alias("text"))


def _replies(spark, sf_dir) -> DataFrame:
    """item_id, reply: JSON answers with the faults that generated ones have, by item_id modulo 8."""
    plain = F.regexp_replace(F.col("text"), r'["\\\x00-\x1f]+', " ")
    good = F.concat(F.lit('{"question": "'), plain, F.lit('", "final_answer": " '), F.substring(plain, 1, 40), F.lit(' "}'))
    kind = F.col("item_id") % 8
    return _table(spark, sf_dir, "benchmark").select(
        "item_id",
        "text",
        F.when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit(" ```\n"), good, F.lit("\n``` \n")))
        .when(kind == 3, F.replace(good, F.lit('"'), F.lit("'")))
        .when(kind == 4, F.concat(good, F.lit(" as asked")))
        .when(kind == 5, F.concat(F.lit('{"question": 5, "final_answer": null, "n": '), F.col("item_id"), F.lit("}")))
        .when(kind == 6, F.concat(F.lit('{"question": "'), plain, F.lit('"}')))
        .when(kind == 7, F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(good)
        .alias("reply"),
    )


def clean_json(spark, sf_dir):
    return _replies(spark, sf_dir).select("item_id", text_of.without_fences(F.col("reply")).alias("cleaned"))


def parse_qa_json(spark, sf_dir):
    cleaned = text_of.without_fences(F.col("reply"))
    return _replies(spark, sf_dir).select(
        "item_id",
        text_of.json_field(cleaned, "question").alias("question"),
        text_of.json_field(cleaned, "final_answer").alias("final_answer"),
    )


def qa_gate(spark, sf_dir):
    kind = F.col("item_id") % 5
    question = F.when(kind == 1, F.lit(" Who published it? ")).when(kind == 2, F.concat(F.lit("Who chaired "), "text")).otherwise(F.col("text"))
    answer = F.when(kind == 3, F.lit("  short  ")).when(kind == 4, F.concat(F.lit("See Recommendation "), "text")).otherwise(F.substring("text", 1, 60))
    return _table(spark, sf_dir, "benchmark").select("item_id", gates.good_pair(question, answer).alias("good"))


def _lines(spark, sf_dir) -> DataFrame:
    """line_no, value: items as numbered lines with repeats, every fifth unnumbered, every eleventh blank."""
    number, text = F.col("item_id"), F.regexp_replace("text", r"\s+", " ")
    value = (
        F.when(number % 11 == 10, F.lit("  "))
        .when(number % 5 == 4, text)
        .otherwise(F.concat(F.lit(" "), (number % 17).cast("string"), F.lit(" . "), text, F.lit(" ")))
    )
    return _table(spark, sf_dir, "benchmark").select((number + 1).alias("line_no"), value.alias("value"))


def parse_questions_strict(spark, sf_dir):
    return evaluate.questions_strict(_lines(spark, sf_dir))


def parse_questions_lenient(spark, sf_dir):
    return evaluate.questions_lenient(_lines(spark, sf_dir))


def scan_questions(spark, sf_dir):
    """The lines as text files, in their order, and read back by position."""
    path = scratch(spark, "lines")
    _lines(spark, sf_dir).repartitionByRange(3, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return evaluate.questions_lenient(readers.lines(spark, path))


def scan_tolerant(spark, sf_dir):
    """JSON lines of which every seventh is broken."""
    path, plain = scratch(spark, "tolerant"), F.regexp_replace("text", r"\s+", " ")
    good = F.to_json(F.struct(F.col("item_id").cast("int").alias("qid"), plain.alias("answer")))
    broken = F.concat(F.lit('{"qid": '), plain)
    _table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 7 == 3, broken).otherwise(good).alias("value")).write.text(path)
    return readers.jsonl(spark, path, "qid int, answer string", strict=False)


def scan_raft(spark, sf_dir):
    path = scratch(spark, "raft")
    sinks.jsonl(_raft(spark, sf_dir).select("instruction", "input", "output"), path, single=False)
    return readers.jsonl(spark, path, readers.RAFT)


def resume_rows(spark, sf_dir):
    """A run that wrote the documents of one language, and one that adds what is missing."""
    path, rows = scratch(spark, "resumed"), _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    sinks.append_missing(rows.where("lang = 'en'"), path, "doc_id")
    sinks.append_missing(rows, path, "doc_id")
    return spark.read.parquet(path)


def vector_table(spark, sf_dir):
    """A collection of vectors that is written, replaced, and read as its last version."""
    path = scratch(spark, "vectors")
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    sinks.index(rows.where("label is null"), path)
    sinks.index(rows, path)
    return readers.vectors(spark, path).select("id", "label", F.size("vector").alias("dims"))


def markdown_files(spark, sf_dir):
    """Pages as Markdown files, one each, read back in the order of their names."""
    folder = scratch(spark, "markdown")
    name = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(".html"))
    sinks.markdown(_table(spark, sf_dir, "pages").select(name.alias("file_name"), readers.html_markdown(F.col("html")).alias("text")), folder)
    return readers.corpus(spark, folder).select("doc_no", "doc_name", "text")


def dedupe_last(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("k"), F.col("item_id").alias("line_no"), "text")
    return evaluate.dedupe_last(rows, "k", "line_no")


def _frozen(spark, sf_dir) -> DataFrame:
    """qid, chunk_ids: the two best documents by keyword, and for every third question one that is unknown."""
    best = bm25.topk(_questions(spark, sf_dir), _corpus(spark, sf_dir), 2)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("bm25_rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"])
    unknown = F.when(F.col("qid") % 3 == 0, F.array(F.concat(F.lit("unknown_"), F.col("qid").cast("string"))))
    return best.groupBy("qid").agg(ids.alias("ids")).select("qid", F.concat(F.coalesce(unknown, F.array().cast("array<string>")), "ids").alias("chunk_ids"))


def _known(spark, sf_dir) -> DataFrame:
    docs = _corpus(spark, sf_dir)
    return docs.select(F.col("id").cast("string").alias("id"), F.col("source").alias("pdf_name"), "text", "ord")


def frozen_contexts(spark, sf_dir):
    found = evaluate.frozen_contexts(_questions(spark, sf_dir), _frozen(spark, sf_dir), _known(spark, sf_dir))
    return found.select("qid", "question", F.size("sources").alias("n_sources"), prompts.source_blocks(F.col("sources")).alias("sources"))


def write_contexts(spark, sf_dir):
    """Contexts written as JSON and read back, with what the writing job counted as missing."""
    path = scratch(spark, "contexts")
    report = evaluate.write_contexts(_questions(spark, sf_dir), _frozen(spark, sf_dir), _known(spark, sf_dir), path, strict=False)
    found = readers.jsonl(spark, path, readers.FROZEN_CONTEXTS)
    return found.select(
        F.col("qid").cast("bigint").alias("qid"), "question", F.size("sources").alias("n_sources"), prompts.source_blocks(F.col("sources")).alias("sources"),
        F.lit(report["n_missing"]).cast("bigint").alias("n_missing"),
    )


def missing_chunks(spark, sf_dir):
    return evaluate.missing_chunks(_frozen(spark, sf_dir), _known(spark, sf_dir))


def _answered(spark, sf_dir) -> DataFrame:
    """conv_id, turn, text: assistant turns as a transcript block, the turn's text also as its source."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    source = F.struct(
        F.concat(F.lit("c "), F.col("conv_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("pdf_name"),
        F.col("text"),
    )
    return turns.select("conv_id", "turn", evaluate.render_transcript(F.col("text"), F.array(source)).alias("text"))


def render_transcript(spark, sf_dir):
    return _answered(spark, sf_dir)


def parse_transcript(spark, sf_dir):
    """Each conversation's blocks as one run, against its turns in order as the questions."""
    turns = _answered(spark, sf_dir)
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    runs = turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns.select("conv_id", place.alias("pos"), F.col("turn").alias("qid"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("question"))
    found = evaluate.parse_transcript(runs, asked, ("conv_id",))
    first = F.try_element_at("sources_used", F.lit(1))
    return found.select(
        "conv_id", "qid", "question", "answer", F.size("sources_used").alias("n_sources"),
        *(first[c].alias(c) for c in ("label", "chunk_id", "pdf_name", "snippet")),
    )


def scan_transcript(spark, sf_dir):
    """All blocks as one transcript of several files, cut at the rules and parsed."""
    path = scratch(spark, "transcript")
    _answered(spark, sf_dir).repartitionByRange(3, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").select("text").write.text(path)
    answer, sources = evaluate.parsed_block(F.col("block"))
    found = evaluate.transcript_file(spark, path).select("block_no", answer.alias("answer"), sources.alias("s"))
    first = F.try_element_at("s", F.lit(1))
    return found.select("block_no", "answer", F.size("s").alias("n_sources"), *(first[c].alias(c) for c in ("label", "chunk_id", "pdf_name", "snippet")))


def truncate_answer(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    marked = F.concat(F.lit(" "), F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit("\n[S2] more <END_ANSWER> rest")).otherwise(F.lit(" \n--- rest")))
    return turns.select("conv_id", "turn", text_of.truncated(marked).alias("answer"))


def score_rubric(spark, sf_dir):
    graded = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    graded = graded.select("source", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("grounded"))
    return evaluate.score_rubric(graded, "source")


def manifest_profile(spark, sf_dir):
    """Pages as entries of a CSV manifest, some with padded names, some without an organisation or a note."""
    number, path = F.col("page_id"), scratch(spark, "manifest")
    rows = _table(spark, sf_dir, "pages").select(
        F.concat(F.when(number % 7 == 3, " ").otherwise(""), F.lit("page "), number.cast("string"), F.when(number % 5 == 1, " ").otherwise("")).alias("pdf_name"),
        F.when(number % 4 != 2, F.regexp_extract("url", "://([^/:?#]*)", 1)).alias("source_org"),
        F.concat(F.lit('Page "'), number.cast("string"), F.lit('", kept')).alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), (number % 365).cast("int")).alias("date_accessed"),
        F.when(number % 3 == 0, F.col("url")).alias("notes"),
    )
    # Spaces at the ends are kept by reader and writer, and quotes are doubled, as in any CSV.
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.manifest(spark, path).groupBy(F.coalesce("source_org", F.lit("")).alias("source_org")).agg(
        F.count("*").alias("n_files"),
        F.count("notes").alias("n_notes"),
        F.count_if(F.col("pdf_name") != strip(F.col("pdf_name"))).alias("n_padded"),
        F.sum(F.length("title")).alias("n_title_chars"),
        F.min("date_accessed").alias("first_accessed"),
    )


def ingest_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url", readers.html_markdown(F.col("html")).alias("text"))


def convert_pages(spark, sf_dir):
    """Pages as bytes, through the converter that keeps tables, links and nested lists, or has an error in place of a text."""
    files = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("file_name"), F.encode("html", "UTF-8").alias("content"))
    return readers.converted(files, html.HtmlConverter())


def lsa_topk(spark, sf_dir):
    """The encoder is fitted to the documents, and finds for each question the nearest of them."""
    corpus = _corpus(spark, sf_dir)
    model = lsa.fit(corpus)
    found = vectors.topk(vectors.embed(_questions(spark, sf_dir), model, "qid", "question"), vectors.embed(corpus, model, "id", "text", keep=("ord",)))
    return found.select("qid", F.col("id").alias("doc_id"), "sem_rank", F.round("distance", 6).alias("distance"))


NAMES = (
    "tokenize paragraphs paragraph_windows chunk_pack chunk_ids term_freq term_stats bm25_topk index_topk index_segments vector_topk ann_topk hash_embed rrf_fuse "
    "hybrid_topk build_prompt oracle_gate oracle_sample distractor_sample clean_json parse_qa_json qa_gate raft_records raft_split "
    "sft_format parse_questions_strict parse_questions_lenient dedupe_last frozen_contexts missing_chunks render_transcript "
    "parse_transcript truncate_answer answers_extractive score_rubric corpus_profile manifest_profile scan_chunks ingest_pages "
    "answers_resumable sanity_answers questions_asked scan_questions scan_tolerant scan_raft resume_rows vector_table markdown_files "
    "write_contexts scan_transcript convert_pages lsa_topk"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


FLAGSHIP = build_prompt
SETTINGS = DEFAULT
