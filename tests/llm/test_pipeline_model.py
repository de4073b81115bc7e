"""The pipeline's rows against its five stages in plain Python, and its edges."""

import base64
import hashlib
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from quarry.llm import quality, queries
from quarry.llm.common import table

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def near(rows):
    """Of each group the row with the smallest id."""
    sets = []
    for _, text in rows:
        w = SPACED.findall((text or "").encode().translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if root(i) == i]  # rows come by id


def passages(rows):
    """Without strings of 400 bytes, and windows of 51 words, that start at two places."""
    data = [(t or "").encode() for _, t in rows]
    places, windows = {}, {}
    for n, d in enumerate(data):
        for k in range(len(d) - 399):
            places.setdefault(hashlib.blake2b(d[k : k + 400], digest_size=12).digest(), []).append((n, k, k + 400))
        at = [m.span() for m in re.finditer(rb"\S+", d)]
        w = [d[a:b] for a, b in at]
        for k in range(len(w) - 50):
            windows.setdefault(tuple(w[k : k + 51]), []).append((n, at[k][0], at[k + 50][1]))
    cover = [bytearray(len(d)) for d in data]
    for found in (*places.values(), *windows.values()):
        if len(found) > 1:
            for n, a, b in found:
                cover[n][a:b] = b"\1" * (b - a)
    rest = [bytes(x for x, c in zip(d, hit, strict=True) if not c) for d, hit in zip(data, cover, strict=True)]
    return [(i, t if t is None else r.decode("utf-8", "ignore")) for (i, t), r in zip(rows, rest, strict=True)]


def clean(rows, items):
    words = lambda t: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = {}
    for text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(len(w[k : k + 13]), set()).add(tuple(w[k : k + 13]))
    out = []
    for i, text in rows:
        w, hit = words(text), set()
        for n, wanted in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.append((i, text))
    return out


def test_pipeline_equals_model(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect())
    model = queries.quality_model(spark, sf_dir)
    rows = [(i, t) for i, t in rows if model.score(np.array([quality.figures(t)], float))[0] >= pipeline.QUALITY]
    rows = clean(passages(near(rows)), [r["text"] for r in table(spark, sf_dir, "benchmark").collect()])
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, sf_dir).collect())
    assert 50 < len(want) and got == want


@pytest.mark.parametrize("kind", ["none", "odd"])
def test_stages_of_odd_tables(spark, sf_dir, none, odd, kind):
    """No rows; nulls in any column, empty and long texts, repeated rows, further columns with names that stages use."""
    docs = none if kind == "none" else odd
    columns = docs.columns
    for name, stage in pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    out = pipeline.tokens(spark, docs, sf_dir)
    assert (out.count() == 0) == (kind == "none")
