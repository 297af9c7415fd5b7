"""Hilbert curve keys of points with integer coordinates (Skilling's transform, vectorised)."""

from __future__ import annotations

import numpy as np


def keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of ``points`` (n x dims, values under 2**bits); dims * bits
    must be under 64."""
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    top = one << np.uint64(bits - 1)
    q = top
    while q > 1:
        p = q - one
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = top
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key
