"""Gradient-boosted trees for two classes, on NumPy alone."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with histogram splits; the same input gives the same model."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 4.0, ridge: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.least, self.ridge, self.bins = rounds, depth, rate, least, ridge, bins
        self.base, self.trees, self.edges = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, value = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            score += value
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        nodes: list[tuple] = []
        out = np.zeros(len(g))

        def leaf(at: np.ndarray) -> int:
            value = self.rate * g[at].sum() / (h[at].sum() + self.ridge)
            out[at] = value
            nodes.append((-1, 0, 0, 0, value))
            return len(nodes) - 1

        def build(at: np.ndarray, depth: int) -> int:
            total_g, total_h = g[at].sum(), h[at].sum()
            best = (1e-6, -1, 0)
            if depth < self.depth and len(at) >= 2 * self.least:
                for f in range(b.shape[1]):
                    size = len(self.edges[f]) + 1
                    if size < 2:
                        continue
                    left_g = np.cumsum(np.bincount(b[at, f], g[at], size))[:-1]
                    left_h = np.cumsum(np.bincount(b[at, f], h[at], size))[:-1]
                    count = np.cumsum(np.bincount(b[at, f], minlength=size))[:-1]
                    gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[(count < self.least) | (len(at) - count < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] < 0:
                return leaf(at)
            _, f, k = best
            nodes.append((f, k, 0, 0, 0.0))
            me = len(nodes) - 1
            go = b[at, f] <= k
            left, right = build(at[go], depth + 1), build(at[~go], depth + 1)
            nodes[me] = (f, k, left, right, 0.0)
            return me

        build(np.arange(len(g)), 0)
        return nodes, out

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        score = np.full(len(x), self.base)
        for nodes in self.trees:
            f, k, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[at] >= 0
                go = b[np.arange(len(x)), np.maximum(f[at], 0)] <= k[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))
