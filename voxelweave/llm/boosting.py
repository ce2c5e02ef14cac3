"""Histogram gradient-boosted trees for binary labels, in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node k of tree t has ``feature``, ``bin`` (go left if code <= bin), children and ``value``.

    A leaf points to itself, so every row takes the same number of steps.
    """

    edges: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        codes, out, rows = self.codes(x), np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                go = codes[rows, self.feature[t, node]] <= self.split[t, node]
                node = np.where(go, self.left[t, node], self.right[t, node])
            out += self.value[t, node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, min_rows: int = 12, l2: float = 1.0) -> Forest:
    """Fit on ``x`` (rows by features, NaN not allowed) and 0/1 ``y``; without both classes, a constant."""
    y = y.astype(float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    p = (y.sum() + 0.5) / (len(y) + 1)
    size = 2 ** (depth + 1) - 1
    me = np.tile(np.arange(size), (trees, 1))
    feature, split, value = np.zeros((trees, size), np.int64), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    left, right = me.copy(), me.copy()
    forest = Forest(edges, feature, split, left, right, value, float(np.log(p / (1 - p))), depth)
    codes, f = forest.codes(x), np.full(len(x), forest.base)
    if len(np.unique(y)) < 2:
        return forest
    n_bins = bins + 1
    flat = codes.astype(np.int64) + np.arange(x.shape[1]) * n_bins
    for t in range(trees):
        prob = 1 / (1 + np.exp(-f))
        g, h = prob - y, prob * (1 - prob)
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * min_rows:
                at = flat[rows].ravel()
                shape = (x.shape[1], n_bins)
                sums = [np.bincount(at, np.repeat(w, x.shape[1]), shape[0] * n_bins).reshape(shape).cumsum(1)[:, :-1] for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = sums
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < min_rows) | (len(rows) - nl < min_rows)] = -1
                j = int(gain.argmax())
                if gain.flat[j] > 1e-6:
                    best = divmod(j, n_bins - 1)
            if best is None:
                value[t, node] = -rate * gs / (hs + l2)
                f[rows] += value[t, node]
                continue
            feature[t, node], split[t, node] = best
            left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            go = codes[rows, best[0]] <= best[1]
            todo += [(2 * node + 1, rows[go], level + 1), (2 * node + 2, rows[~go], level + 1)]
    return forest
