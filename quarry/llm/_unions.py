"""Components of small graphs in numpy."""

from __future__ import annotations

import numpy as np


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the links (i, j), by repeated minimum and pointer jumping."""
    root = np.arange(n)
    while True:
        was = root.copy()
        low = np.minimum(root[i], root[j])
        for at in (i, j, was[i], was[j]):
            np.minimum.at(root, at, low)
        root = root[root]
        if np.array_equal(root, was):
            return root
