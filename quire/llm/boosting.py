"""Gradient-boosted trees on histograms, for small bounded training samples; log loss, trees of a fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees: ``feature`` and ``edge`` of the inner nodes (a row goes right if its value is above the edge), ``leaf`` values."""

    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for each row of ``x``."""
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, edge, leaf in zip(self.feature, self.edge, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Edges between the distinct values of a column, or between its quantiles if there are many."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
    return (values[:-1] + values[1:]) / 2


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 3.0, ridge: float = 1.0) -> Boosted:
    """Trees fitted to rows ``x`` and labels ``y`` (0, 1); ``least``: smallest sum of second derivatives in a leaf."""
    n, width, inner = len(x), x.shape[1], (1 << depth) - 1
    share = min(max(float(y.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    feature, edge = np.zeros((rounds, inner), dtype=np.int64), np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, inner + 1))
    if not n or share in (1e-3, 1 - 1e-3):
        return Boosted(feature[:0], edge[:0], leaf[:0], start)
    edges = [_edges(x[:, j], bins) for j in range(width)]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    score = np.full(n, start)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            size, first = 1 << level, (1 << level) - 1
            at = node - first
            best, split = np.zeros(size), [None] * size
            all_g, all_h = np.bincount(at, g, size), np.bincount(at, h, size)
            for j, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                key, wide = at * (len(cuts) + 1) + binned[j], size * (len(cuts) + 1)
                left_g = np.cumsum(np.bincount(key, g, wide).reshape(size, -1), axis=1)[:, :-1]
                left_h = np.cumsum(np.bincount(key, h, wide).reshape(size, -1), axis=1)[:, :-1]
                right_g, right_h = all_g[:, None] - left_g, all_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (all_g**2 / (all_h + ridge))[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                top = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(size), top] > best + 1e-9):
                    best[k], split[k] = gain[k, top[k]], (j, top[k])
            right = np.zeros(n, dtype=bool)
            for k, found in enumerate(split):
                if found is not None:
                    j, c = found
                    feature[t, first + k], edge[t, first + k] = j, edges[j][c]
                    mine = at == k
                    right[mine] = binned[j][mine] > c
            node = 2 * node + 1 + right
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += leaf[t][at]
    return Boosted(feature, edge, leaf, start)
