"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostingOptions:
    trees: int = 60
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    least_weight: float = 0.2
    l2: float = 1.0


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: a feature and a threshold for each inner node (go
    right if larger), a value for each leaf."""

    features: np.ndarray    # trees x (2 ** depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray      # trees x 2 ** depth
    base: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(rows), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(rows: np.ndarray, labels: np.ndarray, options: BoostingOptions = BoostingOptions()) -> Trees:
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, n_features = 2 ** options.depth - 1, rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, options.bins + 1)[1:-1])) if len(rows) else np.empty(0)
             for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    width = options.bins
    margin = np.full(len(rows), base)
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(options.trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - labels, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for level in range(options.depth):
            first, many = 2 ** level - 1, 2 ** level
            g, h = np.empty((n_features, many, width)), np.empty((n_features, many, width))
            for f in range(n_features):
                cell = (node - first) * width + binned[:, f]
                g[f] = np.bincount(cell, gradient, many * width).reshape(many, width)
                h[f] = np.bincount(cell, weight, many * width).reshape(many, width)
            left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            all_g, all_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
            gain = (left_g ** 2 / (left_h + options.l2) + (all_g - left_g) ** 2 / (all_h - left_h + options.l2)
                    - all_g ** 2 / (all_h + options.l2))
            gain[(left_h < options.least_weight) | (all_h - left_h < options.least_weight)] = 0
            for k in range(many):
                f, cut = divmod(int(gain[:, k].argmax()), width - 1)
                if gain[f, k, cut] > 1e-9 and cut < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = (np.bincount(leaf, v, inner + 1) for v in (gradient, weight))
        values = -options.rate * g / (h + options.l2)
        margin += values[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(values)
    return Trees(np.array(all_features), np.array(all_thresholds), np.array(all_leaves), base)
