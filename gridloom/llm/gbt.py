"""Gradient-boosted trees over document statistics, with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees end to end. A leaf has feature -1 and its own number as both children, so scoring takes the
    same steps for every row: depth times, all rows move to the left child if feature <= threshold, else right."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            z += self.value[at]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Forest:
    """Logistic loss, second-order gains, histograms of `bins` quantiles. monotone: for each feature 1 (the score never
    falls as it grows), -1 (never rises) or 0. A split that breaks its feature's direction is not taken, and the middle
    of both sides bounds what lies below on either side. Without both labels, the smoothed share is every score."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, k), int)
    z = np.full(n, base)

    def best(rows, low, high):
        """(gain, feature, cut) with the highest gain."""
        total_g, total_h = g[rows].sum(), h[rows].sum()
        found = (1e-6, -1, 0, 0.0, 0.0)
        for f in range(k):
            if not len(cuts[f]):
                continue
            gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
            gain[(hl < least / 4) | (hr < least / 4) | (monotone[f] * (vr - vl) < 0)] = 0
            b = int(gain.argmax())
            if gain[b] > found[0]:
                found = (gain[b], f, b, vl[b], vr[b])
        return found

    def grow(rows, level, low, high) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high)) * rate
        nodes.append([0, np.inf, me, me, value])
        if level < depth and len(rows) >= 2:
            gain, f, b, vl, vr = best(rows, low, high)
            if f >= 0:
                middle = (vl + vr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
                is_left = code[rows, f] <= b
                a = grow(rows[is_left], level + 1, *bounds[0])
                c = grow(rows[~is_left], level + 1, *bounds[1])
                nodes[me] = [f, float(cuts[f][b]), a, c, 0.0]
        return me

    def predict(root: int) -> np.ndarray:
        f, t, a, c, v = (np.array(q) for q in zip(*nodes, strict=True))
        at = np.full(n, root)
        for _ in range(depth):
            at = np.where(x[np.arange(n), f[at]] <= t[at], a[at], c[at])
        return v[at]

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            if np.abs(g).max() < 1e-3:
                break
            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
            z += predict(roots[-1])
    flat = [np.array(q) for q in zip(*nodes, strict=True)] if nodes else [np.zeros(0)] * 5
    return Forest(np.array(roots, int), flat[0].astype(int), flat[1], flat[2].astype(int), flat[3].astype(int), flat[4], base, depth)
