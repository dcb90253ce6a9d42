"""Hilbert curve indices of integer grid points, vectorised over numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``cells`` (n x d, values below 2**bits).

    d * bits must not exceed 63. Coordinates are first turned into the transposed index by
    undoing the rotations and reflections of each level from the top, then Gray-decoded and
    interleaved, most significant level first.
    """
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    if d * bits > 63:
        raise ValueError("the index needs more than 63 bits")
    if x.size == 0:
        return np.zeros(cells.shape[0], np.int64)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for axis in range(d):
            high = (x[axis] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(high, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[d - 1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= fix
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            out = (out << np.uint64(1)) | ((x[axis] >> np.uint64(level)) & np.uint64(1))
    return out.astype(np.int64)
