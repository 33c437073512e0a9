"""Gradient-boosted trees for a few thousand rows and a few dozen features: logistic loss, Newton leaves."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited regression trees on quantile thresholds; ``rounds`` of them, shrunken by ``rate``."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: int = 8):
        self.rounds, self.depth, self.rate, self.l2, self.least = rounds, depth, rate, l2, least
        self.trees: list[tuple] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(mean / (1 - mean)))
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
        # a value's bin is the first cut that it doesn't exceed; features have their bins side by side
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
        bins = np.column_stack([np.searchsorted(c, v, "left") + at for c, v, at in zip(cuts, x.T, self.first)])
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, p - y, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self.rate * self._walk(tree, x)
        return self

    def _grow(self, bins, g, h, cuts, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(-total_g / (total_h + self.l2))
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        own, size = bins[rows].ravel(), int(self.first[-1])
        n, sum_g, sum_h = (np.bincount(own, weights=w if w is None else np.repeat(w[rows], len(cuts)), minlength=size) for w in (None, g, h))
        best = (1e-6, None, None)
        for k, points in enumerate(cuts):
            at = slice(self.first[k], self.first[k] + len(points))
            below, left_g, left_h = n[at].cumsum(), sum_g[at].cumsum(), sum_h[at].cumsum()
            gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
            gain = np.where((below >= self.least) & (len(rows) - below >= self.least), gain, -1.0)
            c = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[c] > best[0]:
                best = (float(gain[c]), k, c)
        if best[1] is None:
            return leaf
        low = bins[rows, best[1]] <= self.first[best[1]] + best[2]
        return (best[1], float(cuts[best[1]][best[2]]), self._grow(bins, g, h, cuts, rows[low], depth - 1), self._grow(bins, g, h, cuts, rows[~low], depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        low = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[low] = self._walk(tree[2], x[low])
        out[~low] = self._walk(tree[3], x[~low])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += self.rate * self._walk(tree, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))
