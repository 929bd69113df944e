"""Hashes of any range of a sequence after one pass: prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1  # an odd number, so that it has an inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the 64 (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 2**bits + 1 of each."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE % (1 << 64), inverse):
        p = np.full((1 << bits) + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class RangeHash:
    """Hashes of ranges ``[lo, hi)`` of an integer array; equal ranges have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.powers, self.inverse = _powers(max(12, int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((mix(values.astype(np.uint64) + np.uint64(1))) * self.powers[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, lo, hi) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.inverse[lo]

    def joined(self, head, length, tail) -> np.ndarray:
        """The hash of a range of ``length`` values with hash ``head`` followed by one with hash ``tail``."""
        return head + tail * self.powers[length]
