"""Filter audit, line dedup and retention against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit, line_dedup, retention

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out


def audited(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out = defaultdict(Counter)
    for i, t, lang in docs:
        failed = failing(t or "") + ("E" if i is not None and i > least[t or ""] else "")
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                c, fails = out[lang or "", order, step], x in failed
                c["removed"] += fails and not gone
                c["redundant"] += fails and gone
                c["unique_fails"] += failed == x
                c["good_lost"] += fails and not gone and i is not None and i in good
                c["toxic_lost"] += fails and not gone and i is not None and i in toxic
                gone = gone or fails
                c["kept"] += not gone
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {k: (*(c[n] for n in filter_audit.COUNTS), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def audit_rows(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, lang string, part string").repartition(3)
    y = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, good int")
    rows = filter_audit.audit(d, y).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (*(r[n] for n in filter_audit.COUNTS), r["shapley"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_replay(spark):
    rng = random.Random(2)
    long = lambda n: " ".join(f"w{rng.randrange(n)}" for _ in range(n))
    texts = [long(150), "w " * 120, "SHOUT " * 30, "a | b", "", None, " \t\n", long(99) + " A", long(5000), "É" * 10 + "ABCDEFGHI", long(130) + " #", "ß x " * 60]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 2)]
    docs += [(3, texts[3], "en"), (3, texts[0], "en"), (None, texts[0], "fr"), (None, None, None), *docs[:2]]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 24, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (5, None, None), (900, 1, 1)]
    labels = [(i, q, x) for i, q, x in labels]
    got = audit_rows(spark, docs, labels)
    assert got == audited(docs, labels)
    assert {k[0] for k in got} == {"", "en", "de", "fr"} and len(got) == 4 * 600


def test_audit_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).collect() == []
    rows = filter_audit.audit(odd, labels).where("step = 5").select((F.col("kept") + F.col("good_lost")).alias("n")).distinct().collect()
    assert len(rows) == 2  # what is kept after five steps is the same in every order, for each of the two parts


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))


def deduped(docs, least=20, often=3):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least and i is not None:
                holders[key_of(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < often or (i is not None and i == max(holders[key_of(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_equal_model(spark):
    rng = random.Random(4)
    common = ["All rights reserved by the owner.", "  Subscribe to our newsletter!\r", "É" * 25, "é" * 25, "İSTANBUL is the place to be, x", "short", "x" * 19, "y" * 20]
    docs = []
    for i in range(60):
        lines = [f"own line {rng.random()} of document" for _ in range(rng.randrange(4))]
        lines += rng.sample(common, rng.randrange(len(common))) + ([rng.choice(common).upper()] if i % 5 else [""])
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, common[0] + "\nz"), (None, common[7]), (7, common[0] + "\n" + common[0]), docs[3], docs[3], (103, "\n".join([common[1], "q"] * 3000))]
    docs += [(200, common[1]), (201, common[1] + "\n" + common[1] + "\nlast")]
    rows = spark.createDataFrame([(*r, 1, 2, "k") for r in docs], "doc_id long, text string, line int, n_lines int, `a.b` string").repartition(4)
    found = line_dedup.without_repeated_lines(rows)
    assert found.columns == ["doc_id", "text", "line", "a.b", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found.collect()), key=str)
    assert got == deduped(docs) and any(g[2] > 1000 for g in got)


def test_lines_of_odd_tables(spark, odd, odd_rows, none):
    assert line_dedup.without_repeated_lines(none).collect() == []
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.without_repeated_lines(odd, 5, 2).collect()), key=str)
    assert got == deduped([(r[0], r[1]) for r in odd_rows], 5, 2)


def test_lines_need_no_python(spark, odd):
    plan = line_dedup.without_repeated_lines(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


def retained(clicks, clients):
    """clicks: tuples of a table's columns; clients: (client_id, city)."""
    day = timedelta(days=1)
    cut, since = datetime(2024, 3, 1), datetime(1970, 1, 1)
    city = defaultdict(list)
    for c, name in clients:
        city[c].append(name)
    starts, known = defaultdict(dict), defaultdict(list)
    for click, ts, arrived, client, kind, value, _ in set(clicks):
        if ts is None or client is None:
            continue
        h = zlib.crc32(str(click).encode()) if click is not None else 1
        arrives = arrived and arrived + (h % 100 if h % 3 == 0 else 0) * day
        cents = int(np.floor(100 * value + 0.5)) if value is not None and np.isfinite(value) else 0
        for state in [1] + [0] * bool(arrives and arrives < cut):
            known[state, client].append((ts, cents))
            if kind == "purchase":
                starts[client][state] = min(ts, starts[client].get(state, ts))
    cohort = lambda t: (t - since) // day // 3
    out = defaultdict(lambda: [0, 0, 0, 0])
    for client, s in starts.items():
        moved = len(s) == 2 and cohort(s[0]) != cohort(s[1])
        segment = min([x for x in city[client] if x is not None], default="")
        for state, start in s.items():
            cents = Counter()
            for ts, c in known[state, client]:
                if ts >= start:
                    cents[(ts - start) // (3 * day)] += c
            for period, c in cents.items():
                cell = out[state, segment, cohort(start), period]
                for i, x in enumerate((1, zlib.crc32(str(client).encode()), int(moved), c)):
                    cell[i] += x
    return {k: tuple(v) for k, v in out.items()}


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def random_clicks(n):
    rng = random.Random(n)
    at = lambda: datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(120 * 86_400_000_000))
    rows = []
    for i in range(n):
        ts = at()
        client = 7 if i % 3 == 0 else rng.choice([None, *range(-3, 40)])
        rows.append((i, ts, ts + timedelta(seconds=1), client, rng.choice(["view", "purchase", None]), rng.choice([None, rng.uniform(-5, 90), 0.005]), rng.choice([None, "{}"])))
    rows += [(5000, None, at(), 3, "purchase", 1.0, None), (5001, at(), None, 3, "purchase", 1.0, None), (None, at(), at(), 4, "purchase", 2.0, None)]
    rows += [(5002, at(), at(), 99, "purchase", float("nan"), ""), (5003, datetime(1969, 12, 31, 23), at(), 98, "purchase", -0.015, "")]
    rows += [(*rows[8][:6], "other"), rows[9], rows[9]]  # one id with different properties, equal rows
    return rows


@pytest.mark.parametrize("places", [1, 7, 64])
def test_retention_equals_model(spark, places):
    clicks, clients = random_clicks(900), [(i, f"c{i % 4}" if i % 5 else None) for i in range(-3, 30)] + [(1, "a"), (1, "b"), (None, "x"), (99, "")]
    rows = spark.createDataFrame(clicks, CLICKS).withColumn("client", F.lit(1)).withColumn("known", F.col("props")).repartition(5)
    found = retention.matrix(rows, spark.createDataFrame([(*r, "s") for r in clients], "client_id long, city string, segment string"), places)
    got = found.collect()
    cells = {(r["state"], r["segment"], r["cohort"], r["period"]): (r["users"], r["users_crc32"], r["moved"], r["cents"]) for r in got}
    assert len(cells) == len(got) and cells == retained(clicks, clients)


def test_retention_of_empty_tables(spark):
    clicks, clients = spark.createDataFrame([], CLICKS), spark.createDataFrame([], "client_id long, city string")
    assert retention.matrix(clicks, clients, 3).collect() == []
    some = random_clicks(60)
    got = retention.matrix(spark.createDataFrame(some, CLICKS), clients, 3).collect()
    assert {r["segment"] for r in got} == {""} and len(got) == len(retained(some, []))


def test_heavy_clients_are_dealt_over_several_places(spark):
    clicks = spark.createDataFrame(random_clicks(900), CLICKS)
    hot = retention.heavy(clicks, 16)
    assert hot[7] == 16 and len(hot) <= 64 and sum(hot.values()) <= 8 * 16
    at = retention.Places(16, hot)
    client, salt = np.full(3000, 7), np.arange(3000)
    spread = Counter(at.of(client, salt).tolist())
    assert len(spread) == 16 and max(spread.values()) < 300
    assert set(at.of(np.full(50, 1234), salt[:50]).tolist()) == {int(at.own(np.array([1234]))[0])}


def test_piles_merge_in_any_order():
    rng = np.random.RandomState(1)
    blocks = []
    for _ in range(30):
        block = np.zeros(rng.randint(0, 9), retention.FACT)
        block["client"], block["period"], block["cents"] = rng.randint(0, 4, len(block)), rng.randint(0, 3, len(block)), 1
        blocks.append((block, ["s"]))
    pile = None
    for b in blocks:
        one = retention.Named(retention.merged_facts, retention.FACT, [b])
        pile = one if pile is None else pile + one
    rows, names = pile.whole()
    assert names == ["s"] and rows["cents"].sum() == sum(len(b) for b, _ in blocks) and len(rows) == 12
    assert hashlib.sha256(rows.tobytes()).hexdigest() == hashlib.sha256(retention.merged_facts(np.concatenate([b for b, _ in blocks])).tobytes()).hexdigest()


def test_every_character_with_a_lower_case_is_known(spark):
    points = spark.range(0x110000).where("id < 55296 or id > 57343")
    char = F.udf(chr, "string")(F.col("id").cast("int"))
    wrong = points.select(char.alias("c")).where((F.lower("c") != F.col("c")) & ~F.rlike("c", F.lit(line_dedup.CASED)) & ~F.rlike("c", F.lit("[A-Z]")))
    assert wrong.count() == 0
