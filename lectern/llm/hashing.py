"""Vectorised hashes of byte strings inside a task."""
from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _sized(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


class Prefixes:
    """Hashes of any stretch of a byte array in constant time each: polynomials modulo 2**64, scrambled."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n, inverse = len(data), pow(base, -1, 1 << 64)
        self.inverse = _powers(_sized(n), inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        # Bytes are scrambled first, so that small differences do not cancel.
        np.cumsum(_letters()[data] * _powers(_sized(n), base)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + lengths * np.uint64(MULTIPLIER))

    def every(self, width: int) -> np.ndarray:
        """The hash of each stretch of ``width`` bytes, by its start."""
        if len(self.sums) <= width:
            return np.empty(0, dtype=np.uint64)
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width * MULTIPLIER & (1 << 64) - 1))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours, by the start: block-wise running values from both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    filled = np.concatenate([values, np.full(pad, values[-1], values.dtype)]).reshape(-1, width)
    left = pick.accumulate(filled, axis=1).ravel()
    right = pick.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[:n - width + 1], left[width - 1:n])
