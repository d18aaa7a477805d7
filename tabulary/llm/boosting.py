"""Histogram gradient-boosted trees in numpy, flattened into arrays.

Features are cut into at most ``BINS`` quantile bins once. Trees grow level by
level to a fixed depth on gradient and hessian histograms of the logistic loss.
A forest is three arrays, (tree, node) features and thresholds and (tree, leaf)
values, so scoring walks all rows down one level of a tree per step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Forest:
    """A forest for labels y in {0, 1}; without both labels it is a constant."""
    n, width = x.shape
    nodes, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (n + 1)
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    top = max(len(e) for e in edges) + 1
    margin = np.full(n, forest.bias)
    grown: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, cut, threshold = np.zeros(nodes, np.int64), np.full(nodes, top), np.full(nodes, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = (node - first) * top
            best = np.full(count, 1e-6)
            for j in range(width):
                key = at + binned[:, j]
                g = np.bincount(key, grad, count * top).reshape(count, top)
                h = np.bincount(key, hess, count * top).reshape(count, top)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 10) | (ht - hl < least / 10)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                value = gain[np.arange(count), k]
                better = np.flatnonzero(value > best)
                best[better] = value[better]
                feature[first + better], cut[first + better] = j, k[better]
                if len(better):
                    threshold[first + better] = edges[j][k[better]]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = node - nodes
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    forest.feature, forest.threshold, forest.leaf = (np.stack(z) for z in zip(*grown, strict=True))
    return forest
