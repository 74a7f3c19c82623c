"""64-bit hashes of byte ranges in one buffer, vectorised."""

from __future__ import annotations

import numpy as np

# The public splitmix64 constants.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers, from the 0th, of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        odd = int(GOLDEN) | 1
        for k, b in enumerate((odd, pow(odd, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the polynomial terms of the first 0, 1, 2 ... bytes."""
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:len(data)], out=total[1:])
    return total


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Hash of each byte range; equal bytes have equal hashes wherever they stand."""
    total = prefix_sums(data) if total is None else total
    _, down = powers(len(data) + 1)
    return mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
