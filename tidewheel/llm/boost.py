"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

A tree of depth d is complete: inner node i has children 2i+1 and 2i+2; `feature` and `limit` are
(trees, 2^d - 1), `leaf` is (trees, 2^d). A row goes right where its value exceeds the limit.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, feature, limit, leaf, prior):
        self.feature, self.limit, self.leaf, self.prior = feature, limit, leaf, prior
        self.depth = int(np.log2(leaf.shape[1])) if len(leaf) else 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, all trees and rows stepping down one level at a time."""
        out = np.empty(len(x))
        trees = np.arange(len(self.leaf))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            total = np.full(len(part), self.prior)
            if len(trees):
                node = np.zeros((len(part), len(trees)), np.int64)
                row = np.arange(len(part))[:, None]
                for _ in range(self.depth):
                    node = 2 * node + 1 + (part[row, self.feature[trees, node]] > self.limit[trees, node])
                total += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
            out[lo : lo + 4096] = 1 / (1 + np.exp(-total))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Boosted:
    n, width = x.shape if x.ndim == 2 else (0, 0)
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return Boosted(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    share = y.mean()
    prior = float(np.log(share / (1 - share)))
    total = np.full(n, prior)
    feature, limit, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            best = np.zeros(k)
            for f in range(width):
                at = (node - first) * bins + code[:, f]
                gs = np.bincount(at, g, k * bins).reshape(k, bins).cumsum(axis=1)
                hs = np.bincount(at, h, k * bins).reshape(k, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(hs < least) | (ha - hs < least)] = 0
                gain[:, len(cuts[f]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(k), top] > best + 1e-12
                best[better] = gain[np.arange(k), top][better]
                feature[t, first : first + k][better] = f
                if better.any():
                    limit[t, first : first + k][better] = cuts[f][top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        total += leaf[t][at]
    return Boosted(feature, limit, leaf, prior)
