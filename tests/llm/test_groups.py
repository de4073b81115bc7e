"""Operators that compare rows: embeddings, suffixes, near duplicates, URLs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest

from quarry.llm import components, grid_join, minhash, suffix_dedup, url_filter


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rows = spark.createDataFrame(links, "u long, v long").repartition(4)
    got = {r["vertex"]: r["root"] for r in components.components(rows).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}
    assert components.components(rows.limit(0)).collect() == []


def test_grid_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    rng = np.random.RandomState(3)
    centres = rng.randn(8, 12)
    rows = []
    for i in range(240):
        v = centres[i % 8] + rng.randn(12) * rng.choice([0.02, 0.06, 0.15])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 17 else None))
    rows += [(500 + i, rows[4][1], 1) for i in range(5)]  # equal vectors
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 12, 1), (603, [None] + [1.0] * 11, 1), (604, [math.nan] * 12, 1),
             (605, [math.inf] * 12, 1), (606, rows[4][1][:6], 1), (607, [x * 7 for x in rows[4][1]], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    got = {r["vec_id"]: r for r in grid_join.similar_vectors(table).collect()}
    assert len(got) == len(rows)
    good = [(i, np.float32(v).astype(float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, links = Counter(), []
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                n[i] += 1
                n[j] += 1
                links.append((a, b))
    roots = union(len(good), links)
    least = defaultdict(lambda: 10**9)
    for k, root in enumerate(roots):
        least[root] = min(least[root], good[k][0])
    component = {i: i for i, *_ in rows} | {good[k][0]: least[root] for k, root in enumerate(roots)}
    assert sum(n.values()) > 500
    for i, *_ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], component[i], component[i] == i), i


def test_grid_join_edges(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert grid_join.similar_vectors(table).collect() == []
    table = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 1.0], 1)], table.schema)
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in grid_join.similar_vectors(table).collect())
    assert got == [(0, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4)]


def brute_suffix(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(d, cover, strict=True) if not c)
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_equals_brute_force(odd, odd_rows):
    short = odd.where("n_chars < 50000 or n_chars is null")
    rows = [r for r in odd_rows if r[4] is None or r[4] < 50000]
    got = sorted((str(r["doc_id"]), *r[1:]) for r in suffix_dedup.remove_repeats(short, shown=("kept_sha256",)).collect())
    assert got == sorted((str(r[0]), *x) for r, x in zip(rows, brute_suffix([r[1] for r in rows]), strict=True))


def test_suffix_boundaries_and_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "_BITS", 11)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    a, b = noise(399), noise(700)
    texts = [noise(50) + a, a + noise(50), "x" + b[:400], b[:400] + "y", noise(3000) + b[100:600] + noise(2500), b, noise(20) + b[300:],
             "ab" * 1000, ("ab" * 1000)[1:], "z" * 900, noise(100) + "z" * 401, "q" * 400, "q" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (400, 57):
        got = sorted(suffix_dedup.remove_repeats(docs, length=length, shown=("kept_sha256",)).collect())
        assert [tuple(r)[1:] for r in got] == brute_suffix(texts, length)


def brute_words(texts, words, length):
    """Texts without the repeated windows of so many words or so many bytes."""
    data = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"\S+", d)] for d in data]
    split = [d.split() for d in data]
    seen = Counter(tuple(w[k : k + words]) for w in split for k in range(len(w) - words + 1))
    strings = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d, spans, w in zip(data, at, split, strict=True):
        cover = bytearray(len(d))
        for k in range(len(w) - words + 1):
            if seen[tuple(w[k : k + words])] > 1:
                a, b = spans[k][0], spans[k + words - 1][1]
                cover[a:b] = b"\1" * (b - a)
        for k in range(len(d) - length + 1):
            if strings[d[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        out.append(hashlib.sha256(bytes(x for x, c in zip(d, cover, strict=True) if not c)).hexdigest())
    return out


def test_suffix_words_equal_brute_force(spark, odd, odd_rows, monkeypatch):
    short = odd.where("n_chars < 50000 or n_chars is null")
    rows = [r for r in odd_rows if r[4] is None or r[4] < 50000]
    got = sorted((str(r["doc_id"]), hashlib.sha256(r["rest"]).hexdigest()) for r in suffix_dedup.remove_repeats(short, words=51, shown=("rest",)).collect())
    assert got == sorted((str(r[0]), x) for r, x in zip(rows, brute_words([r[1] for r in rows], 51, 400), strict=True))
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "_BITS", 11)
    rng = random.Random(21)
    noise = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    a, b = noise(50), noise(120)
    texts = [f"p {a} q", f"r {a} s", f"x {b[:120]}", f"y  {b[:120]} z", f"{noise(2600)} {b[40:200]} {noise(300)}", b, f"{b} ", "k " * 300,
             "k " * 200 + "é", "w" * 5000 + " " + b, f"\n{b[2:102]}", f"{b[2:102]}\t", f"{b[2:100]} ", "", "m\n" * 60, b.replace(" ", "\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = [hashlib.sha256(r["rest"]).hexdigest() for r in sorted(suffix_dedup.remove_repeats(docs, words=51, shown=("rest",)).collect())]
    assert got == brute_words(texts, 51, 400)


def test_pipeline_passages(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(22)
    letters = lambda n, few: "".join(rng.choice(few) for _ in range(n))
    short = " ".join(letters(2, "abcdefgh") for _ in range(51))  # 152 bytes
    long = " ".join(letters(40, "abcdefgh") for _ in range(12))  # 491 bytes, 12 words
    script = letters(150, "日本語文字列表現")  # 450 bytes, one word
    fifty = " ".join(letters(5, "abcdefgh") for _ in range(50))  # 299 bytes
    passages = [short, long, script, fifty]
    rows = [(2 * i + k, f"{letters(9, 'xyz')} {x} {letters(9, 'xyz')}", 0) for i, x in enumerate(passages) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pipeline.without_repeated_passages(spark, docs, "").collect()}
    assert all(len(got[i]) < 25 for i in range(6)) and all(fifty in got[i] for i in (6, 7))


def test_suffix_rows_and_empty(odd, none):
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text is null").count() == 2
    assert suffix_dedup.without_repeats(none).count() == 0


def brute_minhash(rows):
    sets = [minhash.exact_set((t or "").encode()) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if minhash.linked(sets[a], sets[b])]
    roots, least = union(len(rows), links), {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return sorted((str(i), len(s), str(least.get(root))) for (i, _), s, root in zip(rows, sets, roots, strict=True))


def test_minhash_equals_brute_force(odd, odd_rows):
    got = minhash.near_duplicates(odd).collect()
    # Empty sets are alone.
    want = brute_minhash([r[:2] for r in odd_rows])
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_groups_of_near_copies(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(15):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_minhash(rows)


@pytest.mark.parametrize("block, crowded", [(minhash.BLOCK, minhash.CROWDED), (8, minhash.CROWDED), (16, 0)])
def test_minhash_of_many_strengths(spark, monkeypatch, block, crowded):
    """Copies from near to far, so that components must be joined beyond the first step, in small blocks and by rare shingles too."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for n in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((n, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(docs).collect())
    want = brute_minhash(rows)
    assert len({c for *_, c in want}) > 5 and got == want


def test_blocks_find_what_links():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    sets = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(100)] = rng.choice(vocabulary)
        sets += [x for x, _, _ in minhash.shingle_sets([" ".join(w).encode()], minhash.Words(b"k"))]
    sigs = [minhash.signature(s) for s in sets]
    links = []
    for band in range(minhash.BANDS):
        groups = defaultdict(list)
        for i in range(40):
            groups[sigs[i][8 * band : 8 * band + 8]].append((band, i, i, sigs[i], sets[i].tobytes()))
        for rows in groups.values():
            if len(rows) > 1:
                links += minhash._Block(rows[1:], rows).forest()
                short = [r[:4] for r in rows]
                block = minhash._Block(short[1:], short)
                alive = {block.keys[k] for k in block.surviving()}
                assert {x for pair in minhash._Block(rows[1:], rows).forest() for x in pair} <= alive
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    want = [(a, b) for a in range(40) for b in range(a) if similar(sets[a], sets[b])]
    assert union(40, links) == union(40, want) and len(set(union(40, want))) > 1


def test_minhash_tasks_grow_with_strangers(spark):
    """A bucket of one large component and one stranger: a row or two for each member, however many blocks."""
    n = 5 * minhash.BLOCK
    buckets = spark.range(n + 1).selectExpr("id as key", "7L as bucket", "3 as band", "10L as n_shingles")
    roots = spark.range(1, n).selectExpr("id as vertex", "0L as root")
    texts = spark.createDataFrame([], "key long, text string")
    made = minhash._tasks(buckets, roots, texts, b"k").groupBy("stranger").count().collect()
    rows = {r["stranger"]: r["count"] for r in made}
    assert rows[False] == n + 1 and rows[True] <= n // minhash.BLOCK + 1


def pages(rng, n):
    """Pages of one template (of 60 words, and 40 of their own: not linked), and near copies of the first 20."""
    words = lambda k: [f"{rng.getrandbits(40):x}" for _ in range(k)]
    template = words(60)
    rows = [template[:30] + words(40) + template[30:] for _ in range(n)]
    rows += [[*row[:-1], "other"] for row in rows[:20]]
    return [(i, " ".join(row)) for i, row in enumerate(rows)]


def test_minhash_tasks_of_crowded_buckets(spark, monkeypatch):
    """Rows grow with the members where a bucket holds many that are not linked; those that are still meet."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    made = []
    for n in (1280, 2560):
        texts = spark.createDataFrame(pages(random.Random(n), n), "key long, text string").repartition(4)
        buckets = texts.selectExpr("key", "7L as bucket", "3 as band", "96L as n_shingles")
        roots = spark.createDataFrame([], "vertex long, root long")
        rows = minhash._tasks(buckets, roots, texts, b"k").collect()
        made.append(len(rows))
        sides = defaultdict(set)
        for r in rows:
            assert r["band"] == minhash.ANY
            sides[r["task"], r["stranger"]].add(r["key"])
        met = {(a, b) for (task, stranger), keys in sides.items() if stranger for a in keys for b in sides[task, False]}
        assert all((i, n + i) in met or (n + i, i) in met for i in range(20))
        assert len(met) < 20 * n
    assert made[1] < 2.5 * made[0] + 1000


def test_prefixes_hold_a_common_shingle():
    """For all sizes and the least overlap that links, the bounds are those of the definition."""
    for n in range(1, 120):
        long, short = minhash.prefixes(n)
        both = [next(k for k in range(1, n + 1) if 100 * k >= 75 * (n + m - k)) for m in range(n, n * 4 // 3 + 1)]
        assert short == n + 1 - both[0] == n + 1 - min(both)
        smaller = [k for m in range(1, n + 1) for k in range(1, m + 1) if 100 * k >= 75 * (n + m - k)]
        assert 1 <= short <= long == n + 1 - min(smaller)


def test_minhash_of_template_pages(spark, monkeypatch):
    """Whole results where all meet by rare shingles."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    monkeypatch.setattr(minhash, "CROWDED", 1)
    rows = pages(random.Random(6), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_minhash(rows)


def test_hashes_of_crafted_words_differ(spark):
    """Thue-Morse strings have one polynomial hash modulo 2^64 at any base, and two words that once had one hash here."""
    one, two = b"a", b"b"
    for _ in range(11):
        one, two = one + two, two + one
    for x, y in ((one, two), (b"aaaaaabeaacbacdbeaacabba", b"bdcbcaaacaaadaaaaacacaaa")):
        words = minhash.Words(b"k")
        assert words[x] != words[y] and words[x] == minhash.Words(b"k")[x] != minhash.Words(b"l")[x]
        docs = spark.createDataFrame([(1, " ".join([x.decode()] * 6)), (2, " ".join([y.decode()] * 6))], "doc_id long, text string")
        assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1, 2}


def test_sets_and_digests():
    words = minhash.Words(b"k")
    digest = lambda text: minhash.set_digest(*minhash.shingle_sets([text], words)[0][1:])
    for text in (b"One two  THREE four\nfive six seven", b"a b", b" \n", b"", b"x " * 20, b"a b c d e"):
        assert len(minhash.shingle_sets([text], words)[0][0]) == len(minhash.exact_set(text))
    assert digest(b"A b c d e") == digest(b"\ta b  c d E ") != digest(b"a b c d f")
    assert digest(b"x " * 20) == digest(b"x " * 30) and digest(b" ") is None
    # One set of shingles in two orders, by a circle of words that is entered at two places.
    circle = b"p q r s t u v w "
    assert digest(circle * 2 + b"p q r s") == digest((circle * 4)[6:]) and digest(b"a b") != digest(b"b a")
    # Two shingles whose hashes are equal only by mistake keep classes apart: equal bytes are equal sets.
    assert minhash.set_digest(np.array([0]), [b"a", b"b"]) != minhash.set_digest(np.array([0]), [b"a", b"c"])


def test_minhash_representatives(odd, none):
    out = minhash.representatives(odd)
    assert out.columns == odd.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 0 in kept and 6 not in kept and None in kept
    assert minhash.representatives(none).count() == 0


def test_representatives_are_one_row_a_group(spark):
    rng = random.Random(31)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    twice, near, without, alone, keyed = (noise(90) for _ in range(5))
    word = "".join(rng.choice("abcdefgh") for _ in range(900))  # no shingles
    changed = lambda x: x[:200] + "changed" + x[200:]
    rows = [(1, twice), (1, twice), (1, twice), (2, near), (2, changed(near)), (3, near), (None, without), (None, without), (None, changed(without))]
    rows += [(4, alone), (None, keyed), (5, keyed), (6, word), (6, word), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, x, f"s{k}") for k, (i, x) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    out = minhash.representatives(docs).cache()
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "4", "5", "6", "7", "8", "None"]
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(out, words=51).collect()}
    assert left[1] == twice and left[4] == alone and left[5] == keyed and left[6] == word
    assert left[2] in (near, changed(near)) and left[None] in (without, changed(without))


def test_pruning_bound_is_monotone():
    needs = minhash.least_equal()
    assert [n for n, _ in needs] == [32, 64, 96, 128] and all(a < b for (_, a), (_, b) in zip(needs, needs[1:], strict=False))
    assert needs[-1][1] < 0.75 * 128


def test_url_filter_as_of(spark):
    day = lambda n: datetime(2024, 1, n)
    entries = [("bad.com", "spam", None, True, day(5)), ("bad.com", "spam", None, False, day(10)), ("ok.bad.com", "exception", True, True, day(1)),
               ("site.org/a/b", "part", None, True, day(3)), ("site.org", "host", None, True, day(8)), ("Upper.NET", "case", False, True, day(1)),
               ("twice.io", "x", None, True, day(2)), ("twice.io", "x", None, False, day(2)), (None, "x", None, True, day(1)), ("n.io", "x", None, True, None)]
    table = spark.createDataFrame(entries, "key string, category string, allow boolean, listed boolean, at timestamp")
    asked = [("http://bad.com/x", day(4), False, None), ("http://www.bad.com:80/x?q#f", day(5), True, "bad.com"), ("https://u@bad.com", day(10), False, None),
             ("http://ok.bad.com/", day(6), False, "ok.bad.com"), ("http://notbad.com/", day(6), False, None), ("http://site.org/a//b/c", day(9), True, "site.org/a/b"),
             ("http://site.org/a/bc", day(9), True, "site.org"), ("http://site.org/a/bc", day(4), False, None), ("HTTP://UPPER.net/Q", day(3), True, "upper.net"),
             ("http://twice.io", day(3), False, None), (None, day(3), False, None), ("no url", day(3), False, None), ("http://bad.com/x", None, False, None),
             ("http://n.io", day(3), False, None)]
    rows = [(i, u, t) for i, (u, t, *_) in enumerate(asked)]
    captures = spark.createDataFrame(rows + rows[:2], "page_id long, url string, fetched timestamp")
    got = url_filter.evaluate(captures, table, keep=("page_id",)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r["blocked"], r["entry"]) == asked[r["page_id"]][2:], asked[r["page_id"]]
    assert url_filter.evaluate(captures, table.limit(0), keep=("page_id",)).where("blocked").count() == 0
    assert url_filter.evaluate(captures.limit(0), table).count() == 0


def test_url_filter_long_keys_and_cases(spark):
    at = datetime(2024, 1, 1)
    deep, wide = "deep.org/" + "/".join("abcdefghijkl"), ".".join("abcdefghij") + ".wide.net"
    keys = [deep, wide, "Case.COM/Dir/Page", "flat.io"]
    listed = spark.createDataFrame([(k, "c", None, True, at) for k in keys], "key string, category string, allow boolean, listed boolean, at timestamp")
    asked = [(f"http://{deep}/m", deep), (f"http://{deep[:-2]}", None), (f"http://x.{wide}/", wide), (f"http://{wide[2:]}/", None), ("http://CASE.com/Dir/Page", "case.com/Dir/Page"),
             ("http://case.com/dir/page", None), ("http://a.b.c.d.e.f.g.h.i.j.k.l.m.n.flat.io/1/2", "flat.io"), ("http://io", None)]
    captures = spark.createDataFrame([(i, u, at) for i, (u, _) in enumerate(asked)], "page_id long, url string, fetched timestamp")
    got = {r["page_id"]: r["entry"] for r in url_filter.evaluate(captures, listed, keep=("page_id",)).collect()}
    assert [got[i] for i in range(len(asked))] == [entry for _, entry in asked]
    only_hosts = {r["page_id"]: r["entry"] for r in url_filter.evaluate(captures, listed.where("key = 'flat.io'"), keep=("page_id",)).collect()}
    assert [only_hosts[i] for i in range(len(asked))] == [None] * 6 + ["flat.io", None]


def test_url_filter_reads_urls_as_clients_do(spark):
    at = datetime(2024, 1, 1)
    listed = spark.createDataFrame([(k, "c", None, True, at) for k in ("bad.com", "part.org/x/y")], "key string, category string, allow boolean, listed boolean, at timestamp")
    bad = ["http://user@x:pw@bad.com/", "http://bad.com\\@good.com/", "http://bad%2ecom/", "http://b%61d%2Ecom:80", " http://bad.com", "\x00\thttp://bad.com\n", "ht\ntp://ba\td.com/",
           "http:\\\\bad.com\\x", "http:/bad.com/", "http:////bad.com", "http://bad.com:/", "http://bad\u3002com/", "http://bad\uff0ecom", "http://u:p@@bad.com#@good.com"]
    good = ["http://good.com/@bad.com", "http://good.com?u=http://bad.com", "http://good.com#@bad.com", "http://good.com\\@bad.com", "http://bad.com@good.com/", "http://bad+com/", "http://bad%com/", "mailto:x@bad.com", "http://", "http://@/"]
    part = ["http://part.org/x/y", "http://part.org/a/../x/./y/", "http://part.org/%2e%2E/x/%2e/y", "http://part.org\\x\\y", "http://part.org/../../x/z/../y/w?q=/.."]
    other = ["http://part.org/x", "http://part.org/x/y/..", "http://part.org/x/..y/y", "http://part.org/?/x/y", "http://part.org/x/.y"]
    asked = [(u, "bad.com") for u in bad] + [(u, None) for u in good] + [(u, "part.org/x/y") for u in part] + [(u, None) for u in other]
    captures = spark.createDataFrame([(i, u, at) for i, (u, _) in enumerate(asked)], "page_id long, url string, fetched timestamp")
    got = {r["page_id"]: r["entry"] for r in url_filter.evaluate(captures, listed, keep=("page_id",)).collect()}
    assert [(u, got[i]) for i, (u, _) in enumerate(asked)] == asked


def test_url_filter_dots_long_hosts_and_shuffled_lists(spark, monkeypatch):
    at = datetime(2024, 1, 1)
    far = "x" * 1500 + ".deep.org"
    keys = ["bad.com", "Dotted.net.", "dotted.org./a.", far, "deep.org/p", "..."]
    listed = spark.createDataFrame([(k, "c", None, True, at) for k in keys], "key string, category string, allow boolean, listed boolean, at timestamp")
    asked = [("http://bad.com./x", "bad.com"), ("http://www.bad.com.:8080", "bad.com"), ("http://bad.com..", "bad.com"), ("http://dotted.net/", "dotted.net"),
             ("http://dotted.org/a./b", "dotted.org/a."), ("http://dotted.org/a", None), (f"http://{far}/p/q", "deep.org/p"), (f"http://{far}/", far),
             ("http://.../x", None), ("http://bad.com/" + "long/" * 5000, "bad.com")]
    # Further columns with names that the join uses itself.
    rows = [(i, u, at, "k", "c", 1) for i, (u, _) in enumerate(asked)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched timestamp, key string, category string, rank int")
    for few in (url_filter.BROADCAST_ROWS, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", few)
        got = {r["page_id"]: r["entry"] for r in url_filter.evaluate(captures, listed, keep=("page_id",)).collect()}
        assert [got[i] for i in range(len(asked))] == [entry for _, entry in asked]
