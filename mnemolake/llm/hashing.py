"""Vectorised hashes of stretches of bytes, the same wherever a stretch lies."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Bytes that are worked on at once, so that temporary arrays stay in cache, and how far a stretch may reach beyond them.
SLAB = 1 << 18
REACH = 1 << 12


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random odd value per byte, and powers of the base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    values = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    out = []
    for step in (base, pow(base, -1, 1 << 64)):
        p = np.full(SLAB + REACH + 1, U(step))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return values, out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


class Prefix:
    """Hashes of any stretch of one slab of bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        values, self.power, self.inverse = _tables()
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values[data] * self.power[:n], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))
