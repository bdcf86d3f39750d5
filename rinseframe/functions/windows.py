"""Keys of long texts that survive edits elsewhere and shifts.

A text is cut into pieces at places that depend on its length rounded down alone. A piece's key is the
least hash among the passages within it, so an unedited piece has the same key wherever it
lies in another text; there the places are tried at which it can lie, and most of them share their least hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: lengths are rounded down to multiples of this; least length of a piece, and of a fine one
STEP = 64
LEAST_PIECE = 16
FINE_PIECE = 16
#: kinds of characters that are counted
KINDS = 64
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    found = []
    for base in (BASE, INVERSE):
        row = np.full(size, base, dtype=U64)
        row[0] = 1
        found.append(np.cumprod(row, dtype=U64))
    return found[0], found[1]


def letter_counts(text: str) -> np.ndarray:
    """How many characters of each of ``KINDS`` kinds; an edit moves one count up, one down, or both."""
    characters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.bincount(characters % KINDS, minlength=KINDS).astype(np.int64)


def shortest(k: int, above: int = 0) -> int:
    """Least length of texts that have keys: enough for more than k pieces, and above a given length."""
    return -(-max(LEAST_PIECE * (k + 1), above + 1) // STEP) * STEP


def text_keys(text: str, k: int, least: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the text's own pieces, in order, and of all places where pieces of texts within k edits may lie.

    Those texts are as long or shorter by up to k, and have ``least`` characters or more.
    Up to ``most`` pieces are cut; without it, as many fine ones as there are.
    """
    characters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(U64)
    n = len(characters)
    forth, back = (p[:n] for p in powers(1 << n.bit_length()))
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(mixed(characters + U64(1)) * forth, out=sums[1:])
    own, asked = np.empty(0, dtype=U64), []
    for base in range(max(n - k, least) // STEP * STEP, n + 1, STEP):
        pieces = max(k + 1, min(most, base // LEAST_PIECE) if most else base // FINE_PIECE)
        edges = base * np.arange(pieces + 1) // pieces
        size = base // pieces // 2
        passages = mixed((sums[size:] - sums[:-size]) * back[: n + 1 - size])
        passages = np.append(passages, U64(2**64 - 1))  # a window may end behind the last one
        nearest, farthest = max(0, n - base - STEP + 1), min(k, n - base)  # how much shorter the other text is
        shifts = np.arange(-((k - nearest) // 2), (k + farthest) // 2 + 1)
        begin, end = (np.add.outer(e, shifts) for e in (edges[:-1], edges[1:]))
        piece = np.broadcast_to(np.arange(pieces)[:, None], begin.shape)
        inside = (begin >= 0) & (end <= n)
        places = np.stack([begin[inside], end[inside] - size + 1], axis=1).ravel()
        salt = mixed((U64(base) << U64(20)) + piece[inside].astype(U64))
        found = mixed(np.minimum.reduceat(passages, places)[::2] ^ salt) if len(places) else own
        asked.append(found)
        if base == n // STEP * STEP:
            here = np.broadcast_to(shifts, begin.shape)[inside] == 0
            own = found[here]
    return own, np.unique(np.concatenate(asked))
