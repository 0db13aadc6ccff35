"""Vectorised hashing of words, lines and character n-grams of many texts at once.

A text's bytes are hashed by prefix sums of a polynomial modulo 2**64, so that the
hash of any substring is one subtraction and one multiplication.  All functions take
the bytes of several texts and their offsets; nothing here spans two texts.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, r, np.uint64))])
                        for r in (_R, _R_INV))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every bit of ``h`` over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Hashed:
    """Prefix hashes of one run of bytes."""

    def __init__(self, buf: np.ndarray):
        powers, self._inverse = _grown(len(buf))
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * powers[:len(buf)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the substrings [start, end)."""
        return mix((self.prefix[end] - self.prefix[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, cut at the offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and n+1 positions of the texts in the word list."""
    start, end = spans(~SPACE[buf], off)
    return start, end, np.searchsorted(start, off)


def owner(first: np.ndarray) -> np.ndarray:
    """Text number of each element, from the texts' n+1 first positions."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive elements within a text: positions, texts, hashes."""
    own = owner(first)
    at = np.flatnonzero(own[:len(own) - n + 1] == own[n - 1:]) if len(own) >= n else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total += h[at + j] * np.uint64(pow(int(_R), j, 1 << 64))
    return at, own[at], mix(total)


def keyed(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit key of (text number, hash)."""
    return mix(h + mix(own.astype(np.uint64) + np.uint64(1)))


def per_text(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags of each text."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return np.diff(total[off])
