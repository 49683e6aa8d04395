"""Gradient-boosted trees for a yes/no label, and isotonic calibration, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Trees of one depth, stored level by level: node i's children are 2i + 1 and 2i + 2."""

    depth: int
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 0.5) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins; weights count relative to their mean."""
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    share = min(max(float(np.average(y, weights=weight)), 1e-3), 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    raw = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for i in range(first, 2 * first + 1):
                own = np.flatnonzero(node == i)
                if len(own) < 2:
                    continue
                best = 1e-9
                for f in range(x.shape[1]):
                    k = len(edges[f]) + 1
                    gs, hs = np.bincount(binned[own, f], g[own], k).cumsum(), np.bincount(binned[own, f], h[own], k).cumsum()
                    gl, hl, gt, ht = gs[:-1], hs[:-1], gs[-1], hs[-1]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(hl < least) | (ht - hl < least)] = 0
                    if len(gain) and gain.max() > best:
                        b = int(gain.argmax())
                        best, feature[i], cut[i], at[i] = gain[b], f, edges[f][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > at[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        raw += leaf[leaf_of]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


@dataclass
class Isotonic:
    """A rising step line through (x, y), straight between its points."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y) if len(self.x) else np.full(len(raw), 0.5)


def fit_isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators; equal raw scores are one point."""
    own = np.ones(len(y)) if weight is None else weight
    if not len(raw):
        return Isotonic(np.zeros(0), np.zeros(0))
    values, where = np.unique(raw, return_inverse=True)
    weight = np.bincount(where, own)
    mean = np.bincount(where, own * y) / weight
    blocks: list[list[float]] = []  # first point, last point, weight, mean
    for i in range(len(values)):
        blocks.append([i, i, weight[i], mean[i]])
        while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
            _, last, w, m = blocks.pop()
            b = blocks[-1]
            b[1], b[3] = last, (b[2] * b[3] + w * m) / (b[2] + w)
            b[2] += w
    x = np.array([v for b in blocks for v in (values[int(b[0])], values[int(b[1])])])
    return Isotonic(x, np.array([v for b in blocks for v in (b[3], b[3])]))
