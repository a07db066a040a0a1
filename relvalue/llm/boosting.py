"""Gradient-boosted trees for a yes-or-no label, trained on a bounded sample in memory."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete binary trees of fixed depth over binned features; logistic loss, second-order gains."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.depth = depth
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        cells = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        mean = np.average(y, weights=weight)
        self.base = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else (20.0 if mean >= 1 else -20.0)
        inner, score = 2**depth - 1, np.full(n, self.base)
        self.feature = np.zeros((trees, inner), np.int32)
        self.limit = np.full((trees, inner), np.inf, np.float32)
        self.value = np.zeros((trees, inner + 1), np.float32)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                local = node - first
                total_g, total_h = np.bincount(local, grad, count), np.bincount(local, hess, count)
                best = np.zeros(count)
                for f in range(width):
                    cell = local * bins + cells[:, f]
                    g = np.bincount(cell, grad, count * bins).reshape(count, bins).cumsum(axis=1)[:, :-1]
                    h = np.bincount(cell, hess, count * bins).reshape(count, bins).cumsum(axis=1)[:, :-1]
                    rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                    gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    gain[(h < 1) | (rest_h < 1)] = 0
                    cut = gain[:, : len(edges[f])].argmax(axis=1) if len(edges[f]) else np.zeros(count, np.int64)
                    won = gain[np.arange(count), cut] if len(edges[f]) else np.zeros(count)
                    for k in np.flatnonzero(won > best + 1e-9):
                        best[k], self.feature[t, first + k], self.limit[t, first + k] = won[k], f, edges[f][cut[k]]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.limit[t, node])
            leaf = node - inner
            self.value[t] = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
            score = score + self.value[t, leaf]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of yes for each row."""
        out, rows = np.full(len(x), self.base, np.float32), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out
