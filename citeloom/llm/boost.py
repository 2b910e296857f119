"""Gradient-boosted decision trees on a bounded sample, for two-class decisions."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, depth-limited trees over quantile thresholds; deterministic."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.model = 0.0, []

    def _grow(self, x, g, h, rows, depth):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 2 * self.least:
            return value
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        score = total_g**2 / (total_h + 1.0)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            place = self.place[f][rows]
            gs = np.bincount(place, g[rows], len(cuts) + 1).cumsum()[:-1]
            hs = np.bincount(place, h[rows], len(cuts) + 1).cumsum()[:-1]
            n = np.bincount(place, minlength=len(cuts) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1.0) + (total_g - gs) ** 2 / (total_h - hs + 1.0) - score
            gain[(n < self.least) | (len(rows) - n < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(cuts[k]))
        if best[1] is None:
            return value
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    def _value(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, low = np.empty(len(x)), x[:, tree[0]] <= tree[1]
        out[low], out[~low] = self._value(tree[2], x[low]), self._value(tree[3], x[~low])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        self.place = [np.searchsorted(cuts, c, side="left") for cuts, c in zip(self.cuts, x.T, strict=True)]
        share = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.model.append(tree)
            z += self.rate * self._value(tree, x)
        del self.place
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.model:
            z += self.rate * self._value(tree, x)
        return 1 / (1 + np.exp(-z))
