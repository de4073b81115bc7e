"""Words of many texts at once, inside tasks: the same ones as text.tokens finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked at together, if they are several.
SIZE = 1 << 24
_BLANK = 0x20
#: Each byte as it is inside a word, or a blank.
_CLASS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else _BLANK for c in range(256))


def coded(texts: list) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of words of each text, none of a null, and the words of all texts in order, with repeats."""
    lowered = [(t or "").lower().encode() for t in texts]
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    data = np.frombuffer((b" ".join(lowered) + b" ").translate(_CLASS), np.uint8)
    inside = data != _BLANK
    # Where a word starts or has ended, in turns, as the last byte is a blank.
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(starts, stops), prepend=0), words.dictionary_encode()


def slices(texts: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """Start and number of neighbours that are looked at together: rows at most, and SIZE bytes unless it is one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SIZE, "right"))
        stop = min(max(stop, start + 1), start + rows, len(texts))
        yield start, stop - start
        start = stop
