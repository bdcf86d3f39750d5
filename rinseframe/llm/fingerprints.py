"""Words of UTF-8 texts as 64-bit fingerprints, and windows of words, in flat numpy arrays.

A word is a run of bytes other than blank and 0x09-0x0D. Its fingerprint is a polynomial
over its bytes, taken from one running sum for many words at once, then mixed. Texts are
worked through in blocks of bounded size that end between words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: bytes whose running sum is held at once
BLOCK = 1 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, other bytes as they are
LOWER = np.where((SAME >= 65) & (SAME <= 90), SAME + 32, SAME).astype(np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit values over the whole word (a bijection)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for the places of a block."""

    def table(base: int) -> np.ndarray:
        steps = np.full(BLOCK + 1, base % 2**64, dtype=U64)
        steps[0] = 1
        return np.cumprod(steps, dtype=U64)

    return table(BASE), table(pow(BASE, -1, 2**64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(WHITE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers()
    result = np.empty(len(starts), dtype=U64)
    i, n = 0, len(starts)
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + BLOCK, side="right"))
        if j == i:  # one word of more than a block: chained over its blocks
            h = U64(0)
            for at in range(int(starts[i]), int(ends[i]), BLOCK):
                part = data[at : min(at + BLOCK, int(ends[i]))].astype(U64) + U64(1)
                h = mixed(np.array([h + (part * up[: len(part)]).sum(dtype=U64)], dtype=U64))[0]
            result[i] = h
            i += 1
            continue
        first, last = int(starts[i]), int(ends[j - 1])
        running = np.empty(last - first + 1, dtype=U64)
        running[0] = 0
        values = data[first:last].astype(U64)
        values += U64(1)
        values *= up[: last - first]
        np.cumsum(values, out=running[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        result[i:j] = (running[e] - running[s]) * down[s]
        i = j
    result += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mixed(result)


def windows(words: np.ndarray, k: int, factor: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Fingerprint of each run of ``k`` neighbouring words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    h = words[:n].copy()
    for t in range(1, k):
        h *= U64(factor)
        h += words[t : t + n]
    return mixed(h)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end with a blank between, and where each text starts.

    Null counts as empty. The last entry of the starts is the end.
    """
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=width, count=n + 1, offset=column.offset * np.dtype(width).itemsize).astype(np.int64)
    source = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    lengths = np.diff(places)
    starts = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    joined = np.full(int(starts[-1]), 0x20, dtype=np.uint8)
    for i in range(n):
        joined[starts[i] : starts[i] + lengths[i]] = source[places[i] : places[i + 1]]
    return joined, starts


def batch_words(column: pa.Array, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a string column, and how many words stand before each text."""
    data, starts = texts_of(column)
    if fold is not None:
        data = fold[data]
    begins, ends = word_spans(data)
    return word_fingerprints(data, begins, ends), np.searchsorted(begins, starts)
