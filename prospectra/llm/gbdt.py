"""Histogram gradient-boosted trees for a binary label, in numpy.

Trees grow level by level on binned features with the logistic loss and are kept as
complete binary trees, flattened into arrays (feature, cut, leaf value), so that all
rows walk all trees with one gather a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    feature: np.ndarray  # (trees, 2**depth - 1) int16
    cut: np.ndarray  # (trees, 2**depth - 1) float64; a row goes right if its value is larger
    leaf: np.ndarray  # (trees, 2**depth) float64
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = inner.bit_length()
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = self.feature[t, node]
                node = 2 * node + 1 + (x[rows, f] > self.cut[t, node])
            out += self.leaf[t, node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, l2: float = 1.0) -> Model:
    """Deterministic: no sampling; ties go to the first feature and the lowest cut."""
    n, m = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    feature, cut, leaf = np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Model(feature[:0], cut[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    offsets = np.arange(m) * bins
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = ((node - first)[:, None] * (m * bins) + offsets + binned).ravel()
            size = width * m * bins
            gs = np.bincount(at, np.repeat(g, m), size).reshape(width, m, bins)
            hs = np.bincount(at, np.repeat(h, m), size).reshape(width, m, bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain = np.where((hl >= least) & (ht - hl >= least), gain, -1.0).reshape(width, -1)
            pick = gain.argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(pick[k]), bins)
                if gain[k, pick[k]] > 1e-9 and b < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            f = feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > cut[t, node])
        where = node - inner
        leaf[t] = rate * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + l2)
        raw += leaf[t][where]
    return Model(feature, cut, leaf, base)
