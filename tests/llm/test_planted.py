"""Queries and their SQL on small tables that hold what the test tables lack: linked vectors, shared lines, moved cohorts."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from quarry.llm import queries
from tests.test_oracle import canonical


def compared(spark, folder, name, **tables):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    found = queries.queries()[name](spark, str(folder))
    rows = canonical(found.columns, [tuple(r) for r in found.collect()])
    assert sorted(names) == sorted(found.columns) and rows == canonical(names, want.fetchall())
    return found


def test_linked_vectors(spark, tmp_path):
    rng = np.random.RandomState(4)
    centres = rng.randn(6, 16)
    rows = []
    for i in range(300):
        v = centres[i % 6] + rng.randn(16) * rng.choice([0.01, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 4) if i % 11 else None))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] * 16, 1), (403, [float("nan")] * 16, 1), (404, [2 * x for x in rows[4][1]], 0)]
    found = compared(spark, tmp_path, "op1_grid_join", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert found.where("n_links > 0").count() > 100 and found.where("not kept").count() > 100


def test_shared_lines(spark, tmp_path):
    rng = random.Random(8)
    common = ["All rights reserved by the owner.", "\tSubscribe to our NEWSLETTER now!\r", "É" * 20, "é" * 20, "x" * 19]
    texts = ["\n".join(rng.sample(common, rng.randrange(5)) + [f"line {rng.random()} here and there"]) for _ in range(50)] + [None, "", "\n", common[0]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert compared(spark, tmp_path, "op12_line_dedup", documents=docs).where("n_dropped > 0").count() > 20


def test_filters_in_all_orders(spark, tmp_path):
    texts = ["w " * 150, " ".join(f"w{i}" for i in range(120)), "LOUD " * 120, "a|b", "", None, " ".join(f"X{i}" for i in range(200)) + " #", "É" * 99 + "ABCDEFGHIJK"] * 3
    docs = spark.createDataFrame([(i, t, ["en", None, "de"][i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 24, 3)], "doc_id long, quality int, toxic int")
    found = compared(spark, tmp_path, "op11_filter_audit", documents=docs, labels=labels)
    assert found.where("toxic_lost > 0 and redundant > 0").count() > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_moved_cohorts(spark, tmp_path, seed):
    rng = random.Random(seed)
    at = lambda: datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(100 * 86_400_000_000))
    rows = []
    for i in range(800):
        ts = at()
        value = rng.choice([None, 0.125, -2.5, float("nan"), rng.uniform(0, 99)])
        rows.append((i, ts, rng.choice([None, ts + timedelta(seconds=2)]), 5 if i % 3 == 0 else rng.choice([None, *range(30)]), rng.choice(["view", "purchase", None]), value, "{}"))
    rows += [rows[3], rows[4], (None, at(), at(), 6, "purchase", 1.0, None)]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string")
    clients = spark.createDataFrame([(i, None if i % 7 == 0 else f"c{i % 3}") for i in range(25)], "client_id long, city string")
    assert compared(spark, tmp_path, "op13_retention", clicks=clicks, clients=clients).where("moved > 0").count() > 0
