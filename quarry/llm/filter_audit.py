"""What each of several filters removes, in every order in which they can be applied.

Direct replay: each document's flags meet all orders of the filters (a table of n! rows, broadcast), the steps of an order are exploded, the
step of the first failure is found, and counts are combined on the map side. What is shuffled is one row for each
part, order and step of a task.

Results at the edges:
* a null text is an empty one: it has no words and no characters, so it fails `short` only;
* every row is a document, also rows with one id; equal rows fail `copy` only if a smaller id has their text;
* a null id is neither smaller nor larger than another and has no labels;
* of several labels of one id any 1 counts;
* parts are compared as text, and null is the empty text; an empty table has no parts and so gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"
#: Parts of a text's documents in the join with repeated texts.
SALTS = 16
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_flags(text: Column) -> Column:
    """Which of the filters on a text alone fail, as bits: few words, repeated words, capitals, marks."""
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    # One structure, so that words are split once.
    counted = F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), 1)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    short = lambda c: (c["n"] < 100).cast("int")
    plain = lambda c: (F.lit(100) * c["d"].cast("long") < F.lit(80) * c["n"].cast("long")).cast("int") * 2
    of_words = F.element_at(F.transform(F.array(counted), lambda c: short(c) + plain(c)), 1)
    shouted = (F.lit(100) * capitals > F.lit(10) * F.length(text)).cast("int") * 4
    marked = F.rlike(text, F.lit(r"[#$%&*|]")).cast("int") * 8
    return of_words + shouted + marked


def flags(
    docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """part, failed (bits A to E), good, toxic of every document.

    Copies are found by SHA-256 of the whole text: the smallest id of each repeated text goes back to its documents, in
    SALTS parts, as one text may be very frequent.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_flags(text).alias("failed"), F.unhex(F.sha2(text, 256)).alias("body"),
    )
    # From the documents again, so that texts are not split into words a second time.
    bodies = docs.select(F.col(id_col).alias("doc"), F.unhex(F.sha2(text, 256)).alias("body")).where("doc is not null")
    first = bodies.groupBy("body").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("final > first").select("body", "first")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "failed"), F.lit(SALTS)).cast("int"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).cast("int") * 16
    no = F.lit(False)
    return rows.join(salted, ["body", "salt"], "left").join(marks, "doc", "left").select(
        "part", (F.col("failed") + copy).alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )


def orders(spark, letters: str = LETTERS) -> DataFrame:
    """order_no, filter_order, bits (of its filters, from left to right): all orders, n! rows."""
    rows = [(i, "".join(p), [1 << letters.index(x) for x in p]) for i, p in enumerate(permutations(letters))]
    return spark.createDataFrame(rows, "order_no int, filter_order string, bits array<int>")


def replay(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, the counts of COUNTS and shapley, from part, failed, good and toxic.

    shapley is what a step's filter removes in all orders, at any step.
    """
    table = orders(found.sparkSession, letters)
    # All orders of a few filters: 120 rows for five.
    crossed = found.crossJoin(F.broadcast(table.select("order_no", "bits")))
    fails = [F.when(F.col("failed").bitwiseAND(F.get("bits", F.lit(i))) != 0, F.lit(i + 1)) for i in range(len(letters))]
    steps = crossed.select("part", "order_no", "failed", "good", "toxic", F.coalesce(*fails, F.lit(0)).alias("first"), F.posexplode("bits").alias("at", "bit"))
    step = F.col("at") + 1
    removed = F.col("first") == step
    fails_here = F.col("failed").bitwiseAND(F.col("bit")) != 0
    conditions = {
        "kept": (F.col("first") == 0) | (F.col("first") > step),
        "removed": removed,
        "redundant": fails_here & (F.col("first") < step),
        "unique_fails": F.col("failed") == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    counted = steps.groupBy("part", "order_no", step.alias("step")).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    named = counted.join(F.broadcast(table.drop("bits")), "order_no").select("part", "filter_order", "step", letter.alias("letter"), *COUNTS)
    # A window holds one row for each order.
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return named.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The five filters of text_flags and of copies, replayed in all 120 orders for each part."""
    return replay(flags(docs, labels, part_col, id_col, text_col))
