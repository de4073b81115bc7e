"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte of a token is mapped to one printable character, so a token is a
sentencepiece piece; its score is the negative rank, so the merge that
sentencepiece takes first is the one of lowest rank. The normaliser is the
identity and adds no dummy prefix. Texts are cut into pre-tokens by a pattern,
each is encoded on its own, and decoding maps ids back to the token bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes. Texts of
any length are encoded whole, in pieces that end where a pre-token ends. Rows are
independent: repeated rows give equal results, an empty table gives an empty one,
and further columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from quarry.llm.common import bounded, ddl, pieces

#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
CACHE_ENTRIES = 150_000
#: Characters matched at a time. Cuts fall on the ends of pre-tokens.
SLICE_CHARS = 1 << 20


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(shifted.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protobuf field: int as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; the unknown piece comes last."""
    characters = byte_characters()
    size = max(ranks.values()) + 1
    names = {rank: "".join(characters[b] for b in token) for token, rank in ranks.items()}
    out = bytearray()
    for rank in range(size):
        # A rank that no token has gets a piece that no text can contain.
        if rank in names:
            piece = _field(1, names[rank].encode()) + _field(2, -float(rank)) + _field(3, 1)
        else:
            piece = _field(1, f"<gap {rank}>".encode()) + _field(2, 0.0) + _field(3, 5)
        out += _field(1, piece)
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


#: The pattern of the public byte-level vocabularies, and the same cut for texts that stay within Latin letters,
#: ASCII digits and common white space: there each class can be listed, which is quicker to match.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
SPACE = "\t-\r \x85\xa0"
LISTED = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^{SPACE}{LATIN}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )
}
PLAIN = re.compile("[\x00-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")


class ByteBpe(dict):
    """Encoder and decoder; as a dict, from pre-token to its ids as little-endian 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.any = regex.compile(pattern)
        self.plain = re.compile(LISTED[pattern]) if pattern in LISTED else None
        self.characters = dict(enumerate(byte_characters()))
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(ranks))

    def learn(self, unseen: list[str]) -> None:
        """Add the ids of pre-tokens: a whole token by its rank, else by the model."""
        rest = []
        for pre_token in unseen:
            rank = self.ranks.get(pre_token.encode())
            if rank is None:
                rest.append(pre_token)
            else:
                self[pre_token] = rank.to_bytes(4, "little")
        mapped = [x.encode().decode("latin-1").translate(self.characters) for x in rest]
        for pre_token, ids in zip(rest, self.model.encode(mapped, num_threads=1) if rest else [], strict=True):
            self[pre_token] = np.asarray(ids, "<u4").tobytes()

    def pre_tokens(self, text: str):
        """Lists of pre-tokens; a long text is matched in slices, each resumed where its last sure match ends."""
        pattern = self.plain if self.plain and PLAIN.fullmatch(text) else self.any
        at = 0
        while len(text) - at > SLICE_CHARS:
            # The last match of a slice may go on in the next one, and so may the run before it.
            sure = list(pattern.finditer(text, at, at + SLICE_CHARS))[:-2]
            if not sure:
                break
            yield [m.group() for m in sure]
            at = sure[-1].end()
        yield pattern.findall(text[at:] if at else text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Unseen pre-tokens of all these texts go to the model in one call."""
        short = [len(text) <= SLICE_CHARS for text in texts]
        cut = [next(self.pre_tokens(text)) if ok else None for text, ok in zip(texts, short, strict=True)]
        self.learn_unseen(cut)
        out = []
        for text, found in zip(texts, cut, strict=True):
            if found is not None:
                out.append(b"".join(map(self.__getitem__, found)))
                continue
            ids = []
            for part in self.pre_tokens(text):
                self.learn_unseen([part])
                ids.append(b"".join(map(self.__getitem__, part)))
            self.learn_unseen(cut)
            out.append(b"".join(ids))
        return out

    def learn_unseen(self, parts: list) -> None:
        wanted = {x for part in parts if part for x in part}
        unseen = [x for x in wanted if x not in self]
        if len(self) + len(unseen) > CACHE_ENTRIES:
            self.clear()
            unseen = list(wanted)
        self.learn(unseen)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple, ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded.clear()
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple = ("ids", "decoded"),
) -> DataFrame:
    """A row per document: its id, n_tokens, and of ids, decoded, ids_sha256, decoded_sha256 what is asked for.

    path names the rank file, which each executor reads where it is installed.
    """
    kinds = {"ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches):
        bpe = loaded(path, pattern)
        for part in pieces(batches, text_col):
            encoded = bpe.encode_many([text or "" for text in part.column(1).to_pylist()])
            edges = np.cumsum([0, *(len(ids) // 4 for ids in encoded)])
            flat = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
            columns = {"n_tokens": pa.array(np.diff(edges), pa.int64())}
            if "ids" in outputs:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))
            if "ids_sha256" in outputs:
                columns["ids_sha256"] = pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string())
            if "decoded" in outputs or "decoded_sha256" in outputs:
                ids = flat.tolist()
                data = [bpe.decode_bytes(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns["decoded"] = pa.array(data, pa.binary()) if "decoded" in outputs else None
                columns["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())
            named = ["n_tokens", *outputs]
            yield pa.RecordBatch.from_arrays([part.column(0), *(columns[c] for c in named)], ["id", *named])

    more = "".join(f", {c} {kinds[c]}" for c in outputs)
    return bounded(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {ddl(docs, id_col)}, n_tokens bigint{more}")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse: a row per document with its id and the bytes of its ids; null ids decode to no bytes."""

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            data = [bpe.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {ddl(encoded, id_col)}, data binary")
