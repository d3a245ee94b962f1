"""Gradient-boosted regression trees for two classes (logistic loss), in numpy over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees, base: float, depth: int, rate: float):
        self.trees, self.base, self.depth, self.rate = trees, base, depth, rate

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, least: float = 3.0) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # bin k: at most edges[k]
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p0 / (1 - p0)))
        score, trees = np.full(len(y), base), []
        inner = (1 << depth) - 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, border, leaf = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32), np.zeros(inner + 1, np.float32)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                best = np.full(width, 1e-6)
                tg, th = np.bincount(local, g, width), np.bincount(local, h, width)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    k = len(edges[f]) + 1
                    cell = local * k + b[:, f]
                    lg = np.cumsum(np.bincount(cell, g, width * k).reshape(width, k), axis=1)[:, :-1]
                    lh = np.cumsum(np.bincount(cell, h, width * k).reshape(width, k), axis=1)[:, :-1]
                    rg, rh = tg[:, None] - lg, th[:, None] - lh
                    gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - (tg**2 / (th + 1))[:, None]
                    gain[(lh < least) | (rh < least)] = 0
                    cut = gain.argmax(axis=1)
                    top = gain[np.arange(width), cut]
                    for w in np.flatnonzero(top > best):
                        best[w], feature[first + w], border[first + w] = top[w], f, edges[f][cut[w]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > border[node])
            local = node - inner
            leaf[:] = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + 1)
            score += leaf[local]
            trees.append((feature, border, leaf))
        return cls(trees, base, depth, rate)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for feature, border, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > border[node])
            out += leaf[node - inner]
        return out
