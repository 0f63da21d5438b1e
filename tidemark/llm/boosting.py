"""Gradient-boosted regression trees for a logistic loss, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Booster:
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]          # feature, bin and leaf value of complete binary trees
    base: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0) -> Booster:
    """Second-order boosting; splits by gain over histograms, leaf values shrunk by one."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Booster(edges, [], float(np.log(share / (1 - share))), depth)
    b = model.binned(x)
    margin = np.full(len(x), model.base)
    inner = 2 ** depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins + 1)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            for k in range(x.shape[1]):
                key = (node - first) * (bins + 1) + b[:, k]
                g = np.bincount(key, grad, width * (bins + 1)).reshape(width, -1).cumsum(1)
                h = np.bincount(key, hess, width * (bins + 1)).reshape(width, -1).cumsum(1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g ** 2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g ** 2 / (total_h + 1)
                gain[(h < least) | (total_h - h < least)] = 0
                where = gain.argmax(1)
                top = gain[np.arange(width), where]
                new = top > best
                best[new] = top[new]
                feature[first:first + width][new] = k
                cut[first:first + width][new] = where[new]
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + 1)
        margin += leaf[at]
        model.trees.append((feature, cut, leaf))
    return model
