"""Hashed features of texts as numpy arrays, for the trained text models."""

from __future__ import annotations

import numpy as np

#: Odd factors of the rolling hashes, one for each place in an n-gram.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def gram_buckets(codes: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Bucket of each run of ``size`` codes, by a hash that differs by size."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, size * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        h += codes[k : k + n] * _FACTORS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h % np.uint32(buckets)).astype(np.int64)
