"""Gradient-boosted trees for logistic loss over binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth; each level splits every node on its own best feature and bin."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b, f = self._bin(x), np.zeros(len(y))
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        f += self.base
        self.trees = []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self.rate * tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        node = np.zeros(len(g), np.int64)
        features, cuts = [], []
        for level in range(self.depth):
            n, best = 1 << level, np.full(1 << level, 1e-6)
            feature, cut = np.zeros(n, np.int64), np.full(n, self.bins + 1)
            for j in range(b.shape[1]):
                at = node * self.bins + b[:, j]
                gs, hs = (np.bincount(at, w, n * self.bins).reshape(n, -1).cumsum(1) for w in (g, h))
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + self.l2) + (ga - gl) ** 2 / (ha - hl + self.l2) - ga**2 / (ha + self.l2)
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                feature, cut, best = np.where(top > best, j, feature), np.where(top > best, k + 1, cut), np.maximum(top, best)
            features.append(feature)
            cuts.append(cut)
            node = node * 2 + (b[np.arange(len(g)), feature[node]] >= cut[node])
        size = 1 << self.depth
        return (features, cuts, np.bincount(node, g, size) / (np.bincount(node, h, size) + self.l2)), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bin(x), np.full(len(x), self.base)
        for features, cuts, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in zip(features, cuts, strict=True):
                node = node * 2 + (b[np.arange(len(x)), feature[node]] >= cut[node])
            f += self.rate * values[node]
        return f


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a * margin + b))): Newton steps, halved until the loss falls."""
    x, start = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 5e-4 * ((w - start) ** 2).sum())

    w = start
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step, size = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * (w - start)), 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
