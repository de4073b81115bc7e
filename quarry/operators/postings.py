"""A persisted keyword index: postings in blocks with block maxima, in segments.

A segment holds three tables:

* `chunks`: the rows as given, in corpus order, with a number n;
* `postings`: a row for each term and part, which is some neighbouring blocks of BLOCK chunks with about PART bytes of text: of each block with the term
  the largest term frequency and the smallest length, and of all its chunks with the term frequency and length; laid out by buckets of terms;
* `terms`: document frequencies, in the same buckets.

The manifest of a version names its segments with their number of chunks and of tokens, and the mean of all raw idf
values of the version. Frequencies, numbers and lengths of segments are summed when the index is read, so a base with
segments appended answers like an index that is built anew.

Each task of a build makes the postings of its own share of the chunks and writes them by buckets; no posting is shuffled. A block that two tasks
share is in a part of each.

A search never reads a text. From the blocks' maxima follows the most that any chunk of a block can score. For a stated set of questions the
postings of asked terms meet by parts; a task scores its blocks by products of matrices, leaves out those that cannot reach the k best scores it has seen for
any question, and hands on what may be among the k best. For more questions the chunks of the most promising blocks are scored first, their k-th score is a
threshold, and only blocks that can still reach it are scored, by shuffles.
A chunk in a block that is left out can't be among the k best, so the others' scores are whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.config import DEFAULT, Settings
from quarry.functions import words
from quarry.operators import bm25
from quarry.sources import versions
from quarry.sources.scratch import Workspace, result

#: Chunks of a block, and buckets that terms are laid out by.
BLOCK, BUCKETS = 64, 32
#: Bytes of text from which a part ends with a block.
PART = 1 << 23
#: How postings are laid out; an index of another layout is an error.
LAYOUT = 2
POSTINGS = "term string, part bigint, block array<bigint>, max_tf array<int>, min_dl array<int>, ends array<int>, docs binary"
#: Of a chunk in docs: its place in the part, the term's frequency in it and its length, as numbers of 4 bytes.
DOC = np.dtype([("at", "<i4"), ("tf", "<i4"), ("dl", "<i4")])
#: Room for the rounding of sums when a bound is compared with a threshold.
SLACK = 1e-6
#: Below the least score above 0, as scores have 9 digits.
LEAST = 5e-10


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _postings(rows: DataFrame) -> DataFrame:
    """POSTINGS of chunks (n, text) that are read in the order of n, made by each task for its own, with the numbers of chunks and of the term's tokens (held, tokens).

    part is the number of its first chunk; docs has a DOC of each chunk, and ends the place in docs behind the last chunk of each block.
    """
    shift = BLOCK.bit_length() - 1

    def made(n: np.ndarray, texts: list) -> pa.RecordBatch:
        lengths, found = words.coded(texts)
        rank = np.argsort(order := pc.sort_indices(found.dictionary).to_numpy())
        key, tf = np.unique(rank[found.indices.to_numpy()].astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), lengths), return_counts=True)
        term, row = key // len(n), key % len(n)
        block, dl, tf = n[row] >> shift, lengths[row].astype(np.int32), tf.astype(np.int32)
        change = np.diff(term, prepend=-1) != 0
        first, each = np.flatnonzero(change), np.flatnonzero(change | (np.diff(block, prepend=-1) != 0))
        edges, own = np.r_[first, len(key)].astype(np.int32), term[each]
        of_term = np.searchsorted(own, np.r_[term[first], len(order)]).astype(np.int32)
        best = lambda f, x: f.reduceat(x, each) if len(key) else x
        ends = np.r_[each[1:], len(key)][: len(each)] - first[np.searchsorted(term[first], own)]
        listed = lambda edge, x: pa.ListArray.from_arrays(edge, pa.array(x))
        docs = np.empty(len(key), DOC)
        docs["at"], docs["tf"], docs["dl"] = n[row] - n[0], tf, dl
        places = pa.py_buffer((edges * DOC.itemsize).astype(np.int32))
        columns = {
            "term": found.dictionary.take(pa.array(order[term[first]])), "part": pa.array(np.full(len(first), n[0], np.int64)), "block": listed(of_term, block[each]),
            "max_tf": listed(of_term, best(np.maximum, tf)), "min_dl": listed(of_term, best(np.minimum, dl)), "ends": listed(of_term, ends.astype(np.int32)),
            "docs": pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, places, pa.py_buffer(docs)]), "held": np.diff(edges).astype(np.int32),
            "tokens": np.add.reduceat(tf.astype(np.int64), first) if len(key) else np.zeros(0, np.int64),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        n, texts, held = np.zeros(0, np.int64), [], 0
        for batch in batches:
            for start, size in words.slices(batch.column(1), bm25.ROWS):
                more = batch.column(1).slice(start, size)
                n, held = np.r_[n, batch.column(0).slice(start, size).to_numpy()], held + more.nbytes
                texts += more.to_pylist()
                # Another task's numbers are far away; with enough of its own a part ends, but the last block may go on.
                cuts = list(np.flatnonzero(np.diff(n >> 31)) + 1)
                if held >= PART:
                    cuts.append(int(np.flatnonzero(np.diff(n >> shift, prepend=-1))[-1]))
                    held = 0 if cuts[-1] else held
                for low, high in pairwise([0, *sorted(cuts)]):
                    if high > low:
                        yield made(n[low:high], texts[low:high])
                if cuts:
                    n, texts = n[max(cuts) :], texts[max(cuts) :]
        if texts:
            yield made(n, texts)

    return rows.mapInArrow(run, f"{POSTINGS}, held int, tokens bigint")


def _write_segment(chunks: DataFrame, store: versions.Store, buckets: int, text: str, added: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Write the tables of a segment; its entry in the manifest."""
    spark, name = chunks.sparkSession, versions.fresh(store, "segment")
    at = f"{store.top}/{name}"
    order = ["ord", "id"] if "ord" in chunks.columns else ["id"]
    dealt = chunks.repartitionByRange(*order).sortWithinPartitions(*order)
    # After the ranges are drawn, as drawing them reads the rows once more.
    dealt = added(dealt) if added else dealt
    dealt.withColumn("n", F.monotonically_increasing_id()).write.parquet(f"{at}/chunks")
    rows = spark.read.schema(dealt.withColumn("n", F.lit(0).cast("bigint")).schema).parquet(f"{at}/chunks")
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        store.delete(name)
        raise ValueError(f"ids that occur twice: {[r['id'] for r in twice]}")
    made = _postings(rows.select("n", F.col(text).alias("text"))).withColumn("bucket", bucket(F.col("term"), buckets))
    made.write.partitionBy("bucket").parquet(f"{at}/postings")
    written = spark.read.schema(made.schema).parquet(f"{at}/postings")
    df = written.groupBy("bucket", "term").agg(F.sum("held").alias("df"), F.sum("tokens").alias("tokens"))
    df.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
    total = spark.read.schema("tokens bigint").parquet(f"{at}/terms").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return {"name": name, "n": rows.count(), "tokens": int(total), "layout": LAYOUT}


class Index:
    """A version of an index, as it was when it was opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, versions.Store(spark, path)
        found = versions.current(self.store)
        if found is None:
            raise FileNotFoundError(f"no index at {path}; build it first")
        self.number, self.manifest = found
        self.buckets = self.manifest["buckets"]
        self.segments = self.manifest["segments"]
        if any(s.get("layout") != LAYOUT for s in self.segments):
            raise ValueError(f"the index at {path} has another layout; build it again")
        self.n_docs = sum(s["n"] for s in self.segments)
        self.avgdl = sum(s["tokens"] for s in self.segments) / self.n_docs if self.n_docs else 0.0

    def _tables(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        found = [reader.parquet(f"{self.store.top}/{s['name']}/{name}").withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, found)

    def chunks(self) -> DataFrame:
        """All chunks as given, with segment and n."""
        return self._tables("chunks")

    def terms(self) -> DataFrame:
        """bucket, term, df of each segment."""
        return self._tables("terms", "term string, df bigint, bucket int")

    def postings(self) -> DataFrame:
        return self._tables("postings", f"{POSTINGS}, bucket int")


def _mean_raw(index_terms: DataFrame, n_docs: int) -> float:
    """The mean of all terms' raw idf, which replaces negative ones in part."""
    df = index_terms.groupBy("term").agg(F.sum("df").alias("df"))
    raw = F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return df.agg(F.coalesce(F.avg(raw), F.lit(0.0))).first()[0]


def _commit(spark: SparkSession, store: versions.Store, segments: list[dict], buckets: int, after: int | None) -> None:
    shown = [spark.read.schema("term string, df bigint, bucket int").parquet(f"{store.top}/{s['name']}/terms") for s in segments]
    mean = _mean_raw(reduce(DataFrame.unionByName, shown), sum(s["n"] for s in segments))
    folders = [s["name"] for s in segments]
    versions.commit(store, {"folders": folders, "segments": segments, "buckets": buckets, "mean_raw": mean}, after)


def build(chunks: DataFrame, path: str, buckets: int = BUCKETS, text: str = "text", added: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Replace the index at a path, or make it, by chunks (id, ord, text and any further columns).

    ord is the corpus order; without it ids are. Ids must be unique: an id that occurs twice is an error, and the index stays as it was.
    added makes further columns of the chunks, row by row and in their order. Null and empty texts are chunks of length 0. buckets should grow with the vocabulary: a search reads the buckets of its terms.
    """
    spark, store = chunks.sparkSession, versions.Store(chunks.sparkSession, path)
    found = versions.current(store)
    segment = _write_segment(chunks, store, buckets, text, added)
    _commit(spark, store, [segment], buckets, found and found[0])


def append(chunks: DataFrame, path: str, text: str = "text", added: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Add a segment of new chunks, with the columns of the others. An id that the index has is an error."""
    index = Index(chunks.sparkSession, path)
    known = chunks.select("id").join(index.chunks().select("id"), "id", "left_semi").limit(5).collect()
    if known:
        raise ValueError(f"ids that the index has: {[r['id'] for r in known]}")
    segment = _write_segment(chunks, index.store, index.buckets, text, added)
    _commit(index.spark, index.store, [*index.segments, segment], index.buckets, index.number)


def merge(spark: SparkSession, path: str, text: str = "text") -> None:
    """Make one segment of all: fewer files, and blocks of neighbours."""
    index = Index(spark, path)
    segment = _write_segment(index.chunks().drop("segment", "n"), index.store, index.buckets, text)
    _commit(spark, index.store, [segment], index.buckets, index.number)


def weights(index: Index, asked: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """bucket, qid, term, w (idf times the question's frequency) of terms that the index has."""
    inside = asked.withColumn("bucket", bucket(F.col("term"), index.buckets))
    df = _of_buckets(index.terms(), inside).join(inside.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    df = df.groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    raw = F.log(F.lit(float(index.n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = F.when(raw < 0, F.lit(settings.epsilon * index.manifest["mean_raw"])).otherwise(raw)
    return inside.join(df.select("bucket", "term", idf.alias("idf")), ["bucket", "term"]).select("bucket", "qid", "term", (F.col("idf") * F.col("qtf")).alias("w"))


def _of_buckets(table: DataFrame, asked: DataFrame) -> DataFrame:
    """Only the buckets of the asked terms; there are as many numbers at most as the index has buckets."""
    wanted = [r[0] for r in asked.select("bucket").distinct().collect()]
    return table.where(F.col("bucket").isin(wanted) if wanted else F.lit(False))


def _part(tf: Column, dl: Column, index: Index, settings: Settings) -> Column:
    tf = tf.cast("double")
    return tf * (settings.k1 + 1.0) / (tf + settings.k1 * (1.0 - settings.b + settings.b * dl / F.lit(index.avgdl)))


def bounds(index: Index, weighted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """qid, segment, block, most: what the chunks of a block can score at most, for blocks with a term of the question.

    Only the maxima are read. A negative weight adds nothing to a bound.
    """
    tops = F.arrays_zip("block", "max_tf", "min_dl")
    found = _of_buckets(index.postings(), weighted).select("bucket", "term", "segment", tops.alias("tops")).join(weighted, ["bucket", "term"])
    found = found.select("qid", "segment", "w", F.inline("tops").alias("block", "max_tf", "min_dl"))
    part = F.greatest(F.col("w"), F.lit(0.0)) * _part(F.col("max_tf"), F.col("min_dl"), index, settings)
    return found.groupBy("qid", "segment", "block").agg(F.sum(part).alias("most"))


def scored(index: Index, weighted: DataFrame, blocks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """qid, segment, n, score of the chunks of some blocks (qid, segment, block) that hold a term of the question."""
    found = _of_buckets(index.postings(), weighted).drop("max_tf", "min_dl").join(weighted, ["bucket", "term"])
    found = found.select("qid", "segment", "part", "w", "docs", "ends", F.posexplode("block").alias("i", "block"))
    found = found.join(blocks.select("qid", "segment", "block"), ["qid", "segment", "block"])
    start = F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))
    own = F.substring("docs", start * DOC.itemsize + 1, (F.get("ends", F.col("i")) - start) * DOC.itemsize)
    rows = _each(found.select("qid", "segment", "part", "w", own.alias("docs")))
    part = F.col("w") * _part(F.col("tf"), F.col("dl"), index, settings)
    return rows.groupBy("qid", "segment", (F.col("part") + F.col("at")).alias("n")).agg(F.round(F.sum(part), 9).alias("score"))


def _each(rows: DataFrame) -> DataFrame:
    """A row for each chunk of docs, with at, tf and dl."""
    names = [*rows.columns[:4], *DOC.names]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, bm25.ROWS):
                part = batch.slice(start, bm25.ROWS)
                docs = _read(part.column(4))
                times = pa.array(np.repeat(np.arange(part.num_rows), pc.binary_length(part.column(4)).to_numpy() // DOC.itemsize))
                columns = [*(c.take(times) for c in part.columns[:4]), *(pa.array(docs[c].copy()) for c in DOC.names)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in names[:4])
    return rows.mapInArrow(run, f"{kinds}at int, tf int, dl int")


def _read(docs: pa.Array) -> np.ndarray:
    """The chunks of all rows' docs, in order."""
    return np.frombuffer(b"".join(docs.to_pylist()), DOC)


def candidates(
    index: Index, questions: DataFrame, k: int, settings: Settings = DEFAULT, work: Workspace | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights, all bounds, and of these the ones that can still hold one of the k best."""
    work = work or Workspace(index.spark)
    weighted = work.written(weights(index, bm25.question_terms(questions), settings), "weights")
    every = work.written(bounds(index, weighted, settings), "bounds")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "segment", "block"))
    first = every.withColumn("r", best).where(F.col("r") <= k)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    reached = scored(index, weighted, first, settings).withColumn("r", place).where((F.col("r") == k) & (F.col("score") > 0))
    left = every.join(reached.select("qid", F.col("score").alias("reached")), "qid", "left")
    left = left.where(F.col("reached").isNull() | (F.col("most") + SLACK >= F.col("reached")))
    return weighted, every, left.select("qid", "segment", "block")


def topk(questions: DataFrame, index: Index, k: int = DEFAULT.k_bm25, settings: Settings = DEFAULT) -> DataFrame:
    """qid, id, ord, bm25_rank, score: the same rows as bm25.topk gives for the index's chunks."""
    work = Workspace(index.spark)
    asked = bm25.question_terms(questions)
    qids = [r[0] for r in questions.select("qid").distinct().limit(bm25.QUESTIONS + 1).collect()]
    weighted = work.written(weights(index, asked, settings), "weights")
    few = len(qids) <= bm25.QUESTIONS and weighted.limit(bm25.PAIRS + 1).count() <= bm25.PAIRS
    chunks = index.chunks()
    keys = chunks.select("segment", "n", (F.col("ord") if "ord" in chunks.columns else F.col("id")).alias("ord"))
    # Scores below zero put chunks behind those without a term; that needs the scores of all.
    if few and weighted.where("w < 0").limit(1).count() == 0:
        found = _best(index, weighted, qids, questions.schema["qid"].dataType, k, settings)
    else:
        weighted, _, left = candidates(index, questions, k, settings, work)
        found = scored(index, weighted, left, settings)
    found = work.written(work.written(found, "best").join(keys, ["segment", "n"]), "scored")
    corpus = keys.select(F.struct("segment", "n").alias("id"), "ord")
    ranked = bm25.ranked(found.select("qid", F.struct("segment", "n").alias("id"), "ord", "score"), questions, corpus, k, "ord")
    # k rows for each of a set of questions against the chunks' ids.
    ids = chunks.select("segment", "n", F.col("id").alias("chunk"))
    ranked = ranked.withColumnRenamed("id", "at").join(ids, (F.col("at.segment") == ids["segment"]) & (F.col("at.n") == ids["n"]))
    return result(ranked.select("qid", F.col("chunk").alias("id"), "ord", "bm25_rank", "score"), "ranked", work)


def _best(index: Index, weighted: DataFrame, qids: list, kind, k: int, settings: Settings) -> DataFrame:
    """qid, segment, n, score of the chunks that are among the k best of a task for a question, with scores above 0. No weight is below 0."""
    weights = bm25.Weights(qids, [tuple(r) for r in weighted.select("qid", "term", "w").collect()])
    held, number, avgdl = index.spark.sparkContext.broadcast(weights), to_arrow_type(kind), index.avgdl
    shift = BLOCK.bit_length() - 1
    terms = index.spark.createDataFrame(list(enumerate(weights.terms)), "t int, term string")
    rows = _of_buckets(index.postings(), weighted).join(F.broadcast(terms), "term")
    rows = rows.select("segment", "part", "t", "block", "max_tf", "min_dl", "docs")
    rows = rows.repartition("segment", "part").sortWithinPartitions("segment", "part")

    def value(tf, dl):
        return tf * (settings.k1 + 1.0) / (tf + settings.k1 * (1.0 - settings.b + settings.b * dl / avgdl))

    def scores(rows: pa.RecordBatch, floor: np.ndarray):
        """All of a part."""
        asked, names, start = held.value, pa.array(held.value.qids, number), rows.column(1)[0].as_py()
        term, (block, top, least) = rows.column(2).to_numpy(), (rows.column(c).flatten().to_numpy() for c in (3, 4, 5))
        each = np.repeat(term, rows.column(3).value_lengths().to_numpy())
        block, group = np.unique(block, return_inverse=True)
        order = np.argsort(group, kind="stable")
        can = asked.reaches(group[order], each[order], value(top, least)[order], len(block), floor - SLACK)
        docs = _read(rows.column(6))
        each, at = np.repeat(term, pc.binary_length(rows.column(6)).to_numpy() // DOC.itemsize), docs["at"]
        left = can[np.searchsorted(block, (start + at.astype(np.int64)) >> shift)]
        if not left.any():
            return
        # Of one part, so the place tells chunks apart and is their order.
        each, tf, dl = each[left], docs["tf"][left], docs["dl"][left]
        chunk, row = np.unique(at[left], return_inverse=True)
        order = np.argsort(row, kind="stable")
        for r, q, score in asked.best(row[order], each[order], value(tf, dl)[order], len(chunk), k, floor):
            segment, n = np.full(len(r), rows.column(0)[0].as_py(), np.int32), start + chunk[r].astype(np.int64)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(segment), pa.array(n), pa.array(score)], ["qid", "segment", "n", "score"])

    def run(batches):
        floor, rest = np.full(len(held.value.qids), LEAST), None
        for batch in batches:
            rest = pa.concat_batches([rest, batch]) if rest is not None else batch
            # The last part may go on.
            segment, part = rest.column(0).to_numpy(), rest.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(segment) != 0) | (np.diff(part) != 0)) + 1)]
            for low, high in pairwise(edges):
                yield from scores(rest.slice(low, high - low), floor)
            rest = rest.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield from scores(rest, floor)

    return rows.mapInArrow(run, f"qid {kind.simpleString()}, segment int, n bigint, score double")
