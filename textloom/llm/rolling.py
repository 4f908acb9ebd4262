"""Hashes of any byte range of a buffer in constant time, as numpy arrays."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n + n // 8, 1 << 16)  # what a worker keeps is little more than what it needs
        have = _powers[base] = np.multiply.accumulate(np.full(size, base, np.uint64))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class RangeHashes:
    """Polynomial hashes modulo 2**64; ranges with equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.back = powers(pow(BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = self.sums[1:]
        terms += data
        terms += np.uint64(1)
        terms *= powers(BASE, n)
        np.cumsum(terms, out=terms)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def of_every(self, size: int) -> np.ndarray:
        """Hashes of the ranges of ``size`` bytes at every start."""
        n = len(self.sums) - size
        sums = self.sums[size:] - self.sums[:n]
        sums *= self.back[:n]
        sums += np.uint64(size)
        return mix(sums)
