"""Histogram gradient-boosted trees on a bounded sample, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete binary trees by level: children of node i are 2i + 1 and 2i + 2.
    A node that isn't split sends every row left."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); rows above go right
    value: np.ndarray  # (trees, leaves)
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values, all rows and trees a level at a time."""
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.value[tree, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Probability of label 1."""
        parts = [1 / (1 + np.exp(-self.margin(x[i:i + rows]))) for i in range(0, len(x), rows)]
        return np.concatenate(parts) if parts else np.zeros(0)


def constant(score: float) -> Forest:
    """A forest that gives every row one score."""
    odds = float(np.log(score / (1 - score)))
    return Forest(np.zeros((1, 1), dtype=np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), odds, 1)


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0,
    least: float = 2.0,
) -> Forest:
    """Logistic boosting: each level is one histogram of gradients and curvatures
    over (node, feature, bin); a split has ``least`` curvature on both sides.
    Without rows, or with one label only, all rows get the smoothed share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return constant(share)
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(features)])
    flat = binned + np.arange(features) * bins
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    out = [np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * features * bins + flat).ravel()
            size = width * features * bins
            g = np.bincount(key, np.repeat(gradient, features), size).reshape(width, features, bins)
            h = np.bincount(key, np.repeat(curve, features), size).reshape(width, features, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(hl < least) | (ha - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // bins, best % bins
            split_bin = np.where(good, b, bins)
            for i in np.flatnonzero(good):
                out[0][t, first + i], out[1][t, first + i] = f[i], cuts[f[i]][b[i]]
            at = node - first
            right = binned[np.arange(len(y)), f[at]] > split_bin[at]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, curve, leaves)
        out[2][t] = rate * g / (h + l2)
        margin += out[2][t][leaf]
    return Forest(*out, base, depth)
