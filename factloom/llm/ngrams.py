"""Hashed character n-grams of whole texts as arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Odd multipliers for the characters of an n-gram.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, each between two zeros, and where each begins (its zero); one more entry for the end."""
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.flatnonzero(points == 0)


def hashed(symbols: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The bin of the n-gram that begins at each symbol; bins is a power of two. The last n - 1 symbols begin none."""
    size = len(symbols) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = symbols[:size] * _FACTORS[0]
    for k in range(1, n):
        h ^= symbols[k : k + size] * _FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h & np.uint32(bins - 1)
