"""Histogram gradient-boosted trees for two classes, on numpy arrays.

Values become quantile bins; every level of a tree is grown from histograms of
gradients over (node, feature, bin).  The trees are complete binary trees kept
in flat arrays, so a batch goes down all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    depth: int = 4
    bins: int = 48
    rate: float = 0.2
    ridge: float = 1.0
    least_rows: int = 8


@dataclass(frozen=True)
class Forest:
    """Node i of a tree has children 2i+1 and 2i+2; the last level holds the values."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): a larger value goes right
    value: np.ndarray  # (trees, leaves)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature) or not len(x):
            return np.full(len(x), self.start)
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        rows, which = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            right = x[rows, self.feature[which, at]] > self.cut[which, at]
            at = 2 * at + 1 + right
        return self.start + self.value[which, at - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Forest:
    """Fit on rows x (rows, features) and classes y (0 or 1).

    Without rows the margin is 0 (probability 0.5); with a single class it is
    that class's smoothed share.
    """
    inner = 2**settings.depth - 1
    rows, features = x.shape if x.ndim == 2 else (0, 0)
    share = (y.sum() + 1) / (rows + 2) if rows else 0.5
    start = float(np.log(share / (1 - share)))
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    if rows < 2 * settings.least_rows or len(np.unique(y)) < 2:
        return none
    edges = [_edges(x[:, f], settings.bins) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = settings.bins
    offsets = binned + np.arange(features) * width
    margin = np.full(rows, start)
    all_features, all_cuts, all_values = [], [], []
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, bin_cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
        at = np.zeros(rows, np.int64)
        for level in range(settings.depth):
            first, nodes = 2**level - 1, 2**level
            index = ((at - first)[:, None] * (features * width) + offsets).ravel()
            shape, size = (nodes, features, width), nodes * features * width
            g = np.bincount(index, np.repeat(grad, features), size).reshape(shape)
            h = np.bincount(index, np.repeat(hess, features), size).reshape(shape)
            n = np.bincount(index, minlength=size).reshape(shape)
            gl, hl, nl = g.cumsum(2), h.cumsum(2), n.cumsum(2)
            gr, hr, nr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl, nl[:, :, -1:] - nl
            whole = gl[:, :, -1:] ** 2 / (hl[:, :, -1:] + settings.ridge)
            gain = gl**2 / (hl + settings.ridge) + gr**2 / (hr + settings.ridge) - whole
            gain[(nl < settings.least_rows) | (nr < settings.least_rows)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], cut[first + k], bin_cut[first + k] = f, edges[f][b], b
            at = 2 * at + 1 + (binned[np.arange(rows), feature[at]] > bin_cut[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = settings.rate * g / (h + settings.ridge)
        margin = margin + value[leaf]
        all_features.append(feature)
        all_cuts.append(cut)
        all_values.append(value)
    return Forest(np.array(all_features), np.array(all_cuts), np.array(all_values), start)
