"""Position of integer grid points on the Hilbert curve, for whole blocks of points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Key of each row of ``grid`` (n x dims, values below ``2**bits``) along the curve.

    Works from the highest bit down on all points at once: each level undoes the
    reflection or exchange of axes that the curve makes there, then the axes'
    bits are Gray-decoded and interleaved. ``dims * bits`` is at most 62.
    """
    n, dims = grid.shape
    if dims * bits > 62:
        raise ValueError("the key does not fit in 62 bits")
    axes = [grid[:, d].astype(np.int64) for d in range(dims)]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            set_here = (axes[d] & bit) != 0
            swapped = np.where(set_here, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(set_here, axes[0] ^ low, axes[0] ^ swapped)
            if d:
                axes[d] = axes[d] ^ swapped
    for d in range(1, dims):
        axes[d] = axes[d] ^ axes[d - 1]
    fix = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        fix ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | (((axes[d] ^ fix) >> level) & 1)
    return key
