"""The E8 lattice: nearest points and neighbouring cells of many vectors at once."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest lattice vectors; the cells around them touch the cell around the origin."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[s / 2 for s in signs] for signs in product((1, -1), repeat=8) if np.prod(signs) > 0]
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    y = np.rint(x)
    off = x - y
    odd = np.flatnonzero(y.sum(axis=1).astype(np.int64) & 1)
    at = np.abs(off[odd]).argmax(axis=1)
    y[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
    return y


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``x`` (n, 8)."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(n, 1 + probes, 8): own lattice point, then the neighbouring points that lie nearest."""
    home = nearest(x)
    toward = (x - home) @ NEIGHBOURS.T
    near = np.argpartition(-toward, probes - 1, axis=1)[:, :probes] if probes else np.empty((len(x), 0), int)
    return np.concatenate([home[:, None, :], home[:, None, :] + NEIGHBOURS[near]], axis=1)
