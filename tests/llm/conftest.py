import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h string, `key` int, text_hash string"


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, repeated rows, copies, near copies, shared passages."""
    rng = random.Random(5)
    base = [" ".join(words(rng, 120)) for _ in range(6)]
    passage = " ".join(words(rng, 90))
    texts = [*base]
    for t in base[:4]:
        w = t.split()
        w[60] = "changed"
        texts += [t, " ".join(w), t.upper()]
    texts += [f"{base[4][:300]} {passage} {base[5][200:500]}", f"{passage}", f"x {passage} y"]
    texts += ["", " \n\t ", "é", "one two three", "one two three", "\x00\x01 ... !!", "ß日本語 😀 Kelvin", "a" * 1500, "ab" * 900]
    texts += [" ".join(words(rng, 40_000))]
    rows = [(i, t, "en", "src", len(t), "extra", "h", i, None) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None, None, None), (None, base[0], None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None)]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
