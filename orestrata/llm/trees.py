"""Gradient-boosted trees for two classes, small enough to fit on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostedTrees:
    """Complete trees of one depth, stored level by level: feature, cut and leaf arrays of shape (trees, nodes)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, pull: float = 1.0, bins: int = 32) -> BoostedTrees:
    """Newton boosting on binned features. Splits are found level by level from histograms of all features.

    Without a row the trees say one half to everything."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)))[:-1] if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), dtype=int)
    rate_1 = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(rate_1 / (1 - rate_1)))
    z = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = (np.zeros((rounds, k), dtype=t) for k, t in ((inner, np.int64), (inner, np.float64), (leaves, np.float64)))
    for r in range(rounds):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = at - first
            best_gain, best_f, best_b = np.zeros(wide), np.zeros(wide, dtype=np.int64), np.full(wide, bins)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = local * (bins + 1) + binned[:, j]
                gs = np.bincount(key, g, wide * (bins + 1)).reshape(wide, -1).cumsum(axis=1)
                hs = np.bincount(key, h, wide * (bins + 1)).reshape(wide, -1).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + pull) + (ga - gl) ** 2 / (ha - hl + pull) - ga**2 / (ha + pull)
                k = gain.argmax(axis=1)
                top = gain[np.arange(wide), k]
                new = top > best_gain + 1e-9
                best_gain[new], best_f[new], best_b[new] = top[new], j, k[new]
            for i in range(wide):
                feature[r, first + i] = best_f[i]
                c = cuts[best_f[i]]
                # A node without a useful split sends everything to its left.
                cut[r, first + i] = c[best_b[i]] if best_b[i] < len(c) else np.inf
            at = 2 * at + 1 + (x[np.arange(n), feature[r, at]] > cut[r, at])
        at -= inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf[r] = -rate * gs / (hs + pull)
        z += leaf[r][at]
    return BoostedTrees(feature, cut, leaf, start)
