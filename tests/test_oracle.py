"""Every registered query that SQL can express, in Spark and in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: repr(round(float(x), 9) + 0.0) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted("|".join(show(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    found = entry.queries()[name](spark, sf_dir)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    rows = canonical(names, want.fetchall())
    assert rows and canonical(found.columns, [tuple(r) for r in found.collect()]) == rows


def test_rows_of_the_others(spark, sf_dir):
    rows = entry.queries()["answers_extractive"](spark, sf_dir).collect()
    assert len(rows) == 40 and all(r["answer"] for r in rows)
    assert entry.entry(spark).count() == 40
