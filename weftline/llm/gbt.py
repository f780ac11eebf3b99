"""Histogram gradient-boosted trees for two classes, in numpy.

Training cuts each feature into at most ``bins`` quantile bins and grows trees level by level from
histograms of gradients. A fitted model is three flat arrays over complete binary trees (feature,
threshold, leaf value), so that scoring steps all rows down all trees at once.
"""

from __future__ import annotations

import numpy as np


def _loss(total: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -total, total)).mean())


class Trees:
    """A fitted model: ``feature`` and ``threshold`` are trees x inner nodes, ``leaf`` is trees x leaves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf
        self.depth = int(leaf.shape[1]).bit_length() - 1 if leaf.size else 0

    def _steps(self, x: np.ndarray):
        """What each tree adds to each row."""
        rows = np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            yield self.leaf[t, node - (self.leaf.shape[1] - 1)]

    def pruned(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """So many of the first trees as have the least loss on rows that were not learnt from; none, if none helps."""
        if not len(y):
            return self
        total, losses = np.full(len(x), self.base), []
        losses.append(_loss(total, y))
        for step in self._steps(x):
            total += step
            losses.append(_loss(total, y))
        n = int(np.argmin(losses))
        return Trees(self.base, self.feature[:n], self.threshold[:n], self.leaf[:n])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        total = np.full(len(x), self.base)
        for step in self._steps(x):
            total += step
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def constant(share: float) -> Trees:
    """The model of data with one class, or with none."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Trees(float(np.log(share / (1 - share))), np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Boost ``trees`` trees on the rows of ``x`` with labels ``y`` (0 or 1). Deterministic."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, n_features = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    offset = np.arange(n_features) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            slot = (node[:, None] * n_features * bins + offset + binned).ravel()
            size = width * n_features * bins
            shape = (width, n_features, bins)
            sums = [np.bincount(slot, np.repeat(v, n_features), size).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
            gl, hl, nl = sums
            ga, ha, na = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(nl < least) | (na - nl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            for k in np.flatnonzero(split):
                j, b = divmod(int(best[k]), bins)
                feature[t, first + k] = j
                threshold[t, first + k] = edges[j][b] if b < len(edges[j]) else np.inf
            f, c = feature[t, first + node], threshold[t, first + node]
            node = 2 * node + (x[np.arange(n), f] > c)
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = rate * gs / (hs + l2)
        total += leaf[t, node]
    return Trees(base, feature, threshold, leaf)
