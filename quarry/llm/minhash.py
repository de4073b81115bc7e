"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct shingles of five words, told apart by hashes of their words under a key that is
new for every call, so no text can be made to collide. Documents with equal sets, by a digest of all shingles' bytes, form
a class, and only classes go on. A class's signature is cut into bands; classes that agree in a band
share a bucket and are candidates. Signatures are compared batch by batch: after n
hashes, m of them equal, the posterior of the similarity (uniform prior) is a beta distribution, and a
pair is dropped when its chance to reach the threshold is below the chosen miss
probability. Survivors are verified exactly on their texts.

No bucket is expanded into all its pairs. First every class meets the most central member of each
of its buckets, and the most similar of these is verified; what is verified is
contracted. Then, in buckets that still hold several components, the members outside the largest one (strangers) are
compared with all members of other components, in blocks of bounded size, each pair in the first bucket that it shares.
Members with a survivor come back to their block with their sets, and survivors are verified there, against full sets of 64-bit hashes under a second
key; only a spanning forest of the links leaves a block. So a pair of a bucket is left out only if both ends are known to be
connected, and no row is made for a pair. Where the strangers of a bucket are many (unlinked pages of one template, say), rows for
pairs of blocks would grow with its square. Members of such buckets meet by shared rare shingles instead, which loses no pair: in any
total order of all shingles, the first one that two similar sets share stands near the start of both. The order is by how often
shingles occur among these members, so what a template repeats stands last.

Defined cases: documents that are null, empty or without words have no set and link with
nothing; of fewer than five words the whole sequence is the one shingle. Rows are judged by their
texts: repeated rows of an id get equal results. A null id belongs to its component, but never names it;
a component of null ids only has none. An empty table gives an empty one. Texts of any length
are shingled whole; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, bounded, ddl, dropped, freed, pieces, written
from quarry.llm.components import components

SHINGLE = 5
SIMILAR, OF = 75, 100
#: 32 bands of 4: a pair at the threshold shares no bucket with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the chance to lose a pair at the threshold by pruning.
BATCH, MISS = 32, 1e-6
#: Members of a bucket that are compared at a time, each counted once for every HEAVY shingles that it has.
BLOCK, HEAVY = 1024, 1024
#: Blocks of strangers above which a bucket's members meet by rare shingles.
CROWDED = 8
#: Counters of how often shingles occur, told apart by their leading bits: a fixed size, whatever the table's.
CELL_BITS = 20
#: Hashes of words that a task remembers.
REMEMBERED = 1 << 18

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_rng = np.random.RandomState(20)
_PLACE = _rng.randint(1, 1 << 62, SHINGLE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = (_rng.randint(0, 1 << 31, HASHES).astype(np.uint32) << np.uint32(1)) + np.uint32(1)
_PLUS = _rng.randint(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """BLAKE2b of words under a secret key, as 64-bit numbers; those of shorter words are remembered."""

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def shingle_sets(texts: list[bytes], words: Words) -> list[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """The sorted distinct shingle hashes of each text, the word where each first starts, and the text's words.

    A hash is a sum of the words' hashes by place, so it is as secret as they are.
    """
    listed = [text.translate(_LOWER).split() for text in texts]  # bytes are split at 20 and 09 to 0D
    ends = np.cumsum([len(w) for w in listed])
    hashes = np.fromiter(map(words.__getitem__, chain.from_iterable(listed)), np.uint64, int(ends[-1]) if len(ends) else 0)
    m = max(0, len(hashes) - SHINGLE + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        rolled += hashes[j : j + m] * _PLACE[j]
    rolled = _mix(rolled)
    out = []
    for own, b in zip(listed, ends.tolist(), strict=True):
        n = len(own)
        a = b - n
        if n >= SHINGLE:
            out.append((*np.unique(rolled[a : b - SHINGLE + 1], return_index=True), own))
        elif n:
            short = (hashes[a:b] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append((_mix(np.array([short], np.uint64)), np.zeros(1, np.int64), own))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64), own))
    return out


def set_digest(places: np.ndarray, words: list[bytes]) -> bytes | None:
    """BLAKE2b of the bytes of the shingles that start at some words, in this order; null if there are none.

    In the order of their hashes equal sets give equal bytes; and equal bytes are equal sets, whatever the hashes are.
    """
    if not len(places):
        return None
    ends = np.cumsum([len(w) + 1 for w in words])
    line, starts = b" ".join(words), np.concatenate([[0], ends[:-1]])
    last = np.minimum(places + SHINGLE, len(words)) - 1
    held = [line[a:b] for a, b in zip(starts[places].tolist(), (ends[last] - 1).tolist(), strict=True)]
    return hashlib.blake2b(b"\n".join(held), digest_size=16).digest()


def signature(hashes: np.ndarray) -> bytes:
    """The low 16 bits of the least value under each of HASHES permutations."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(half), 2048):
        values = _TIMES[:, None] * half[None, i : i + 2048] + _PLUS[:, None]
        np.minimum(least, values.min(1), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2").tobytes()


def text_hash() -> Column:
    """16 bytes of SHA-256 of the text."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def signed(docs: DataFrame, id_col: str, key: bytes) -> DataFrame:
    """id, at (the text's hash), n_shingles, hash of the set (null if it is empty), signature."""

    def run(batches):
        words = Words(key)
        for part in pieces(batches, "text"):
            sets = shingle_sets(as_bytes(part.column(2)), words)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(s) for s, _, _ in sets], pa.int64()),
                    pa.array([set_digest(at, own) for _, at, own in sets], pa.binary()),
                    pa.array([signature(s) if len(s) else None for s, _, _ in sets], pa.binary()),
                ],
                [id_col, "at", "n_shingles", "hash", "sig"],
            )

    return docs.select(id_col, text_hash().alias("at"), "text").mapInArrow(
        run, f"`{id_col}` {ddl(docs, id_col)}, at binary, n_shingles bigint, hash binary, sig binary"
    )


def least_equal(similar: float = SIMILAR / OF, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, equal ones a pair needs to go on): below it the posterior chance is under miss."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, 0
        while True:  # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
            chance += math.comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def survivors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs that are not pruned, and how many hashes agree in each."""
    at, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    done = 0
    for n, need in least_equal():
        equal = equal + (a[at, done:n] == b[at, done:n]).sum(1)
        keep = equal >= need
        at, equal, done = at[keep], equal[keep], n
    return at, equal


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def exact_set(text: bytes) -> set:
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(a and b) and OF * both >= SIMILAR * (len(a) + len(b) - both)


def _texts(buckets: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """key, text: one text for each class that shares a bucket."""
    wanted = buckets.select("key").distinct().join(classes.select("key", "at"), "key")
    texts = docs.select(text_hash().alias("at"), "text").where(F.col("text").isNotNull())
    # Equal texts have one hash, and each class has one hash here.
    # One plan at every size: what small tables show holds for large ones.
    found = written(texts.join(wanted.hint("merge"), "at").select("key", "text").dropDuplicates(["key"]), "texts")
    freed(docs.sparkSession)
    return found


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs a, b of class keys, those whose sets are similar enough, as links u, v."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        kept: dict[int, set] = {}
        for part in pieces(batches, "tb"):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            good = []
            for x, y, tx, ty in zip(a, b, as_bytes(part.column(2)), as_bytes(part.column(3)), strict=True):
                if len(kept) > 64:
                    kept.clear()
                for key, text in ((x, tx), (y, ty)):
                    if key not in kept:
                        kept[key] = exact_set(text)
                good.append(linked(kept[x], kept[y]))
            take = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(take), part.column(1).filter(take)], ["u", "v"])

    return written(both.mapInArrow(run, "u bigint, v bigint"), "verified")


def _with_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("key").alias(side), F.col("sig").alias(f"s{side}")), side)
    return pairs.select("a", "b", "sa", "sb")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, equal: pairs that survive the sequential comparison of their signatures."""

    def run(batches):
        for part in batches:
            at, equal = survivors(_sigs(part.column(2)), _sigs(part.column(3)))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array(equal, pa.int64())], ["a", "b", "equal"]
            )

    return _with_signatures(pairs, classes).mapInArrow(run, "a bigint, b bigint, equal bigint")


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, band, key of every class in a bucket of two or more, with the bucket's size."""
    bands = F.array(
        *(F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS))
    )
    rows = classes.select("key", "n_shingles", F.posexplode(bands).alias("band", "bucket"))
    many = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "many")
    out = written(rows.join(many, "bucket"), "buckets")
    dropped(many)
    return out


def _star_pairs(buckets: DataFrame) -> DataFrame:
    """Each class with the most central class of each of its buckets: the one whose buckets hold most rows."""
    central = written(buckets.groupBy("key").agg(F.sum("n").alias("c")), "central")
    ranked = written(buckets.join(central, "key").select("bucket", "key", "c"), "ranked")
    heads = written(ranked.groupBy("bucket").agg(F.max(F.struct("c", "key")).alias("head")), "heads")
    pairs = ranked.join(heads, "bucket").where("key <> head.key")
    pairs = written(pairs.select(F.col("key").alias("a"), F.col("head.key").alias("b")).distinct(), "pairs")
    for gone in (central, ranked, heads):
        dropped(gone)
    return pairs


#: The band of members that do not meet by a band.
ANY = -1


class _Block:
    """Members that a task compares: strangers of a bucket with rows of the bucket, each as band, key, root, signature and,
    in the second pass, set. Strangers are all but the members of the bucket's largest component."""

    def __init__(self, strangers: list[tuple], others: list[tuple]):
        rows = [*strangers, *others]
        self.n, self.band = len(strangers), rows[0][0]
        self.keys = [r[1] for r in rows]
        _, self.root = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)
        self.sigs = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(-1, HASHES)
        self.bands = self.sigs.view("<u8")
        self.sets = [np.frombuffer(r[4], np.uint64) for r in rows] if len(rows[0]) > 4 else []

    def partners(self, i: int) -> np.ndarray:
        """Rows of other components that survive the comparison with stranger i; in a bucket of a band, where it is the first they share."""
        at = self.n + np.flatnonzero(self.root[self.n :] != self.root[i])
        if self.band > 0:
            at = at[~(self.bands[at, : self.band] == self.bands[i, : self.band]).any(1)]
        if self.band != ANY:
            at = at[self.bands[at, self.band] == self.bands[i, self.band]]
        return at[survivors(np.broadcast_to(self.sigs[i], (len(at), HASHES)), self.sigs[at])[0]]

    def surviving(self) -> list[int]:
        """Rows with a partner."""
        found: set[int] = set()
        for i in range(self.n):
            at = self.partners(i)
            if len(at):
                found.update(at.tolist(), [i])
        return sorted(found)

    def forest(self) -> list[tuple[int, int]]:
        """Links that connect what the exact links of this block connect."""
        out = []
        for i in range(self.n):
            at = self.partners(i)
            while len(at := at[self.root[at] != self.root[i]]):
                # So many at a time that a link found saves the rest of its component.
                now, at = at[:256], at[256:]
                sizes = np.array([len(self.sets[k]) for k in now])
                every = np.concatenate([self.sets[k] for k in now])
                own = self.sets[i]
                place = np.minimum(np.searchsorted(own, every), len(own) - 1)
                both = np.add.reduceat((own[place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                for k in now[OF * both >= SIMILAR * (len(own) + sizes - both)].tolist():
                    if self.root[k] != self.root[i]:
                        out.append((self.keys[i], self.keys[k]))
                        self.root[self.root == self.root[k]] = self.root[i]
        return out


def _blocks(batches):
    """Number and block of each task of a partition that is sorted by task, from Arrow batches of task, stranger and members' rows."""
    number, held = None, ([], [])
    for batch in batches:
        for task, stranger, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if task != number:
                if held[0] and held[1]:
                    yield number, _Block(*held)
                number, held = task, ([], [])
            held[0 if stranger else 1].append(tuple(row))
    if held[0] and held[1]:
        yield number, _Block(*held)


def _hashed_sets(texts: DataFrame, key: bytes, *others: str) -> DataFrame:
    """key, members (the sorted 64-bit hashes of its shingles) of key, text; other columns stay."""

    def run(batches):
        words = Words(key)
        for part in pieces(batches, "text"):
            found = [x for x, _, _ in shingle_sets(as_bytes(part.column(1)), words)]
            rest = [part.column(2 + i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in found], pa.binary()), *rest], ["key", "members", *others])

    schema = "key bigint, members binary" + "".join(f", {c} {ddl(texts, c)}" for c in others)
    return texts.select("key", "text", *others).mapInArrow(run, schema)


def _blocks_of(weight: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / F.lit(BLOCK))).cast("int")


def _side(rows: DataFrame, own: str, other: str, stranger: bool, *names: Column) -> DataFrame:
    """One side of the tasks of buckets: each row goes to one of its side's blocks (so many as own says), and meets all blocks of the other."""
    mine = F.pmod(F.xxhash64("key"), F.col(own)).cast("int")
    rows = rows.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    at = ("i", "j") if stranger else ("j", "i")
    return rows.select(F.xxhash64("bucket", *names, *at).alias("task"), F.lit(stranger).alias("stranger"), "band", "key", "root")


def _tasks(buckets: DataFrame, roots: DataFrame, texts: DataFrame, key: bytes) -> DataFrame:
    """task, stranger, band, key, root: in buckets with several components, all but the largest one's members (strangers)
    against all rows. Both sides are cut into blocks, and a task is a pair of blocks. With no more than CROWDED blocks of
    strangers, a bucket makes 2 * CROWDED rows for each member at most; the members of others go by rare shingles."""
    rows = buckets.join(roots.select(F.col("vertex").alias("key"), "root"), "key", "left")
    weight = F.col("n_shingles") / F.lit(HEAVY) + 1
    rows = rows.select("bucket", "band", "key", weight.alias("w"), F.coalesce("root", "key").alias("root"))
    rows = written(rows, "rooted")
    sizes = rows.groupBy("bucket", "root").agg(F.sum("w").alias("w"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("n"), F.max_by("root", "w").alias("main"), F.sum("w").alias("all"), F.max("w").alias("most"))
    mixed = mixed.where("n > 1").select("bucket", "main", _blocks_of(F.col("all")).alias("g"), _blocks_of(F.col("all") - F.col("most")).alias("s"))
    mixed = written(mixed, "mixed")
    rooted, rows = rows, written(rows.join(mixed, "bucket"), "dealt")
    dropped(rooted)
    few = rows.where(F.col("s") <= CROWDED)
    out = _side(few.where("root <> main"), "s", "g", True).unionByName(_side(few, "g", "s", False))
    if not mixed.where(F.col("s") > CROWDED).isEmpty():
        crowd = rows.where(F.col("s") > CROWDED).select("key", "root", "w").distinct()
        out = out.unionByName(_rare_tasks(texts.join(crowd, "key"), key))
    dropped(mixed)
    return out


def prefixes(n: int) -> tuple[int, int]:
    """How many leading shingles of a set of n, in a common order, hold the first that it shares with any similar set, and how many do if that
    set is not the smaller one: of n and m >= n shingles, similar ones share SIMILAR * (n + m) / (OF + SIMILAR) at least."""
    return n + 1 + -SIMILAR * n // OF, n + 1 + -2 * SIMILAR * n // (OF + SIMILAR)


def _rare_tasks(members: DataFrame, key: bytes) -> DataFrame:
    """Tasks of key, text, root, w: members that share a shingle of their prefixes, the smaller set's being the short one.

    The order of shingles needs no exact counts, only to be the same everywhere; so counters of a fixed size do, which are the only thing
    that the driver sees.
    """
    crowd = written(_hashed_sets(members, key, "root", "w"), "crowd")
    shift = np.uint64(64 - CELL_BITS)

    def counted(batches):
        often = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            often += np.bincount((held >> shift).astype(np.int64), minlength=len(often))
        at = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(often[at])], ["cell", "n"])

    cells = crowd.select("members").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << CELL_BITS, np.int64)
    often[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    held = members.sparkSession.sparkContext.broadcast(often.tobytes())  # 8 MB

    def leading(batches):
        often = np.frombuffer(held.value, np.int64)
        for part in pieces(batches, "members"):
            taken, sizes, short = [], [], []
            for member in part.column(1).to_pylist():
                own = np.frombuffer(member, np.uint64)
                n, m = prefixes(len(own))
                taken.append(own[np.lexsort((own, often[(own >> shift).astype(np.int64)]))[:n]])
                sizes.append(n)
                short.append(np.arange(n) < m)
            again = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(taken).view(np.int64)), *(part.column(i).take(again) for i in (0, 2, 3)), pa.array(np.concatenate(short))],
                ["bucket", "key", "root", "w", "short"],
            )

    rows = crowd.select("key", "members", "root", "w").mapInArrow(leading, f"bucket bigint, key bigint, root bigint, w {ddl(crowd, 'w')}, short boolean")
    rows = written(rows.withColumn("band", F.lit(ANY)), "leading")
    dropped(crowd)
    brief = F.sum(F.when(F.col("short"), F.col("w")).otherwise(0)).alias("brief")
    sizes = rows.groupBy("bucket", "root").agg(F.sum("w").alias("w"), brief)
    mixed = sizes.groupBy("bucket").agg(
        F.count("*").alias("n"), F.max(F.struct("w", "root", "brief")).alias("main"), F.sum("w").alias("all"), F.sum("brief").alias("brief")
    )
    mixed = mixed.where("n > 1 and brief > 0").select(
        "bucket",
        F.col("main.root").alias("main"),
        _blocks_of(F.col("all")).alias("g"),
        _blocks_of(F.col("all") - F.col("main.w")).alias("s"),
        _blocks_of(F.col("brief")).alias("brief_g"),
        _blocks_of(F.col("brief") - F.col("main.brief")).alias("brief_s"),
    )
    leaders, rows = rows, written(rows.join(mixed, "bucket"), "rare")
    dropped(leaders)
    strangers, brief = rows.where("root <> main"), rows.where("short")
    smaller, larger = F.lit(0), F.lit(1)  # which side the stranger's set is
    return (
        _side(strangers.where("short"), "brief_s", "g", True, smaller)
        .unionByName(_side(rows, "g", "brief_s", False, smaller))
        .unionByName(_side(strangers, "s", "brief_g", True, larger))
        .unionByName(_side(brief, "brief_g", "s", False, larger))
    )


def _residual_links(buckets: DataFrame, classes: DataFrame, roots: DataFrame, texts: DataFrame, key: bytes) -> DataFrame:
    """Links u, v that connect components which share a bucket and hold a pair that is similar enough."""
    rows = written(_tasks(buckets, roots, texts, key).join(classes.select("key", "sig"), "key"), "tasks")
    columns = ["task", "stranger", "band", "key", "root", "sig"]

    def first_pass(batches):
        out: list[tuple] = []

        def flushed():
            done = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["task", "key"])
            out.clear()
            return done

        for number, block in _blocks(batches):
            out += [(number, key) for key in {block.keys[i] for i in block.surviving()}]
            if len(out) >= 4096:
                yield flushed()
        if out:
            yield flushed()

    def second_pass(batches):
        for _, block in _blocks(batches):
            found = block.forest()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    dealt = rows.select(columns).repartition("task").sortWithinPartitions("task")
    alive = written(dealt.mapInArrow(first_pass, "task bigint, key bigint"), "alive")
    texts = texts.join(alive.select("key").distinct(), "key", "left_semi")

    members = written(_hashed_sets(texts, key), "members")
    full = rows.join(alive, ["task", "key"], "left_semi").join(members, "key").select(*columns, "members")
    found = written(full.repartition("task").sortWithinPartitions("task").mapInArrow(second_pass, "u bigint, v bigint"), "more")
    for gone in (rows, alive, members):
        dropped(gone)
    return found


def _grouped(rows: DataFrame, docs: DataFrame, key: bytes) -> DataFrame:
    """hash, root: the component of every set, from marks (at, n_shingles, hash, sig) of docs (text)."""
    classes = rows.where(F.col("hash").isNotNull()).groupBy("hash")
    classes = classes.agg(F.min("at").alias("at"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    # A short number in place of the hash; it stays the same once it is written.
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    buckets = _buckets(classes)
    star = _star_pairs(buckets)
    best = _likely(star, classes).groupBy("a").agg(F.max(F.struct("equal", "b")).alias("best"))
    best = written(best.select("a", F.col("best.b").alias("b")), "best")
    dropped(star)
    texts = _texts(buckets, docs, classes)
    links = _verified(best, texts)
    more = _residual_links(buckets, classes, components(links), texts, hashlib.blake2b(key).digest()[:16])
    for gone in (best, buckets, texts):
        dropped(gone)
    roots = components(links.unionByName(more))
    members = classes.select("hash", "key").join(roots.select(F.col("vertex").alias("key"), "root"), "key", "left")
    members = written(members.select("hash", F.coalesce("root", "key").alias("root")), "members")
    for gone in (classes, links, more, roots):
        dropped(gone)
    return members


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """A row per document: id, n_shingles, component_id (smallest id reachable), kept (the id is the component's).

    key: the secret of the hashes, of up to 64 bytes; a new one for each call if there is none.
    """
    key = key or os.urandom(16)
    base = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(signed(base, "id", key), "marks")
    members = _grouped(rows, base, key)
    marks, rows = rows, written(rows.select("id", "n_shingles", "hash").join(members, "hash", "left").drop("hash"), "standing")
    dropped(marks)
    dropped(members)
    least = written(rows.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id")), "least")
    component = F.coalesce("component_id", "id")
    return rows.join(least, "root", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """One row, with all its columns, for each group: of the smallest id, of its texts the one with the smallest hash.

    Where a whole group has no id, that hash alone decides. Texts without shingles are in no group; of their rows with
    equal id and text one stays, as everywhere.
    """
    key = key or os.urandom(16)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kept = docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    kept = written(kept, "rows")  # numbers stay the same once they are written
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    base = bounded(kept).select(F.struct("row", F.col(own).alias("id")).alias("id"), F.col(text).alias("text"))
    marks = written(signed(base, "id", key), "marks")
    members = _grouped(marks, base, key)
    rows = marks.select("id.row", "id.id", "at", "hash").join(members, "hash", "left")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at", "row"))["row"].alias("row")
    grouped = rows.where("root is not null").groupBy("root").agg(first).select("row")
    alone = rows.where("root is null").groupBy("id", "at").agg(F.min("row").alias("row")).select("row")
    chosen = written(grouped.unionByName(alone), "chosen")
    dropped(marks)
    dropped(members)
    freed(docs.sparkSession)
    left = kept.join(chosen.hint("merge"), "row", "left_semi")
    return left.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
