"""Words and their hashes for many texts at once, in numpy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials over 64-bit values modulo 2^64, mixed at the
end, so the hash of any run of words comes from two prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TABLES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_TABLES[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[i] = np.cumprod(steps, dtype=np.uint64)
    return _TABLES[0][: n + 1], _TABLES[1][: n + 1]


class Prefix:
    """Hash of any run [start, end) of values."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a run of texts: first byte and end of each, hash of each, and for each text the number of its first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; lower: A-Z count as a-z in the hashes."""
    space = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = True
    after[edges[edges > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    hashed = Prefix(_BYTE[_LOWER[data] if lower else data]).run(start, end) if len(data) else np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (across texts too; the caller leaves those out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of `width` values."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        best, have = np.where(values[right] < values[left], right, left), have + step
    return best
