"""Polynomial hashes modulo 2^64 of any part of a buffer, from prefix sums.

With an odd base the powers have inverses, so the hash of data[i:j] is
(sums[j] - sums[i]) times the inverse power of i, wherever the part lies.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``; kept for reuse."""
    global _kept
    if len(_kept[0]) < n:
        n = 1 << max(0, n - 1).bit_length()
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _kept = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _kept


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i] is that of the first ``i`` bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def part_hashes(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    return (sums[start + length] - sums[start]) * powers(len(sums))[1][start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the well-mixed upper bits over all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
