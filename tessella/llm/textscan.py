"""Vectorised word scanning of Arrow text buffers: word bounds and 64-bit word hashes without Python strings.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Prefix sums of a
polynomial over the bytes (modulo 2**64, odd bases) give every word's hash, and the
same sums over word hashes give the hash of any run of words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Odd bases; byte polynomials of lane 0 and 1, word polynomials of lane 0 and 1.
BYTE_BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
WORD_BASES = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))

#: Bytes, or words, that are summed at a time; it bounds the tables of powers, and fits the cache.
PART = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=8)
def _table(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    return _table(int(base), 1 << max(16, int(n).bit_length()))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word count before each row (one more entry than rows)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    end = ~space
    end[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = ~space[inner]
    end[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes unchanged."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    base = BYTE_BASES[lane]
    h = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        # a hash does not depend on where its word stands, so parts of the data are summed on their own
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + PART)))
        part = data[low : ends[j - 1]]
        power, inverse = powers(base, len(part) + 1)
        sums = np.empty(len(part) + 1, U)
        sums[0] = 0
        np.cumsum((part.astype(U) + U(1)) * power[: len(part)], out=sums[1:])
        begin = starts[i:j] - low
        h[i:j] = (sums[ends[i:j] - low] - sums[begin]) * inverse[begin]
        i = j
    return mix(h + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def run_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The hash of every run of ``length`` consecutive word hashes (rows are not told apart here)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    base = WORD_BASES[lane]
    h = np.empty(n, U)
    for i in range(0, n, PART):
        k = min(PART, n - i)
        part = words[i : i + k + length - 1]
        power, inverse = powers(base, len(part) + 1)
        sums = np.empty(len(part) + 1, U)
        sums[0] = 0
        np.cumsum(part * power[: len(part)], out=sums[1:])
        h[i : i + k] = (sums[length:] - sums[:k]) * inverse[:k]
    return mix(h)
