"""Vectorised work on the bytes of many texts at once, for use inside Arrow tasks.

A word is a run of bytes other than space and TAB..CR; A-Z count as a-z. Words are hashed by a polynomial modulo 2**64
over their bytes: with prefix sums, every word of a block costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
BLOCK = 1 << 20  # bytes hashed at once; only a single longer word makes a block longer

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a one-to-one map)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for at, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word; no word crosses one of the text bounds."""
    solid = ~BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(begin), U64), 0
    while at < len(begin):
        lo = int(begin[at])
        upto = max(at + 1, int(np.searchsorted(end, lo + BLOCK, side="right")))
        hi = int(end[upto - 1])
        power, inverse = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((LOWER[data[lo:hi]].astype(U64) + U64(1)) * power[: hi - lo], out=sums[1:])
        b, e = begin[at:upto] - lo, end[at:upto] - lo
        out[at:upto] = mix((sums[e] - sums[b]) * inverse[b] + (e - b).astype(U64))
        at = upto
    return out


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the number of words before each bound, and the first byte of each word."""
    if not len(data):
        return np.empty(0, U64), np.zeros(len(bounds), np.int64), np.empty(0, np.int64)
    begin, end = word_spans(data, bounds)
    return hash_spans(data, begin, end), np.searchsorted(begin, bounds), begin


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of each text, and the number of shingles before each text.

    first: word counts before each bound, as from ``words``. A text of fewer than n words has the whole of them as its only
    shingle, an empty one none.
    """
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    start = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(int(start[-1])) - np.repeat(start[:-1], count) + np.repeat(first[:-1], count)
    width = np.repeat(np.minimum(size, n), count)
    h = width.astype(U64)
    for k in range(n):
        here = at + k
        whole = k < width
        h = np.where(whole, h * U64(0xD6E8FEB86659FD93) + word[np.where(whole, here, 0)], h) if not whole.all() else \
            h * U64(0xD6E8FEB86659FD93) + word[here]
    return mix(h), start


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and len + 1 bounds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``limit`` bytes of text, so that a task's memory follows the longest text only."""
    at = batch.schema.get_field_index(column)
    size = np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0)).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1 if len(size) else []
    lo = 0
    for hi in [*map(int, cut), len(size)]:
        if hi > lo:
            yield batch.slice(lo, hi - lo)
        lo = hi
