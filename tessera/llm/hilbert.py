"""Hilbert curve index of integer grid points, vectorised over points (J. Skilling, Programming the Hilbert curve, 2004)."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of points (n, dims), with 0 <= coordinate < 2 ** bits, along the curve; dims * bits <= 63."""
    n, dims = points.shape
    if dims * bits > 63:
        raise ValueError("dims * bits may not exceed 63")
    axes = [points[:, i].astype(np.int64) for i in range(dims)]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (axes[i] & q) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ np.where(on, low, swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, dims):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> b) & 1, (1 << b) - 1, 0)
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            out = (out << 1) | (((a ^ flip) >> b) & 1)
    return out
