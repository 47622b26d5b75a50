"""Gradient-boosted trees for two classes in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees in five arrays; a leaf points to itself. `roots` has a tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row; every row walks down all trees at once."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows, node = np.arange(len(part))[:, None], np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + 4096] = 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least_rows: int = 20) -> Trees:
    """monotone: 1 where the score may only rise with the feature, -1 where it may only fall, else 0."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    raw = np.full(len(x), base)

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        gr, hr = g[rows], h[rows]
        weight = lambda G, H: np.clip(-G / (H + l2), low, high)
        gain_of = lambda G, H, w: -(G * w + 0.5 * (H + l2) * w * w)
        G, H = gr.sum(), hr.sum()
        whole, best = gain_of(G, H, weight(G, H)), (1e-6, -1, 0, 0.0, 0.0)
        for f, e in enumerate(edges):
            b = binned[f][rows]
            gl, hl = np.cumsum(np.bincount(b, gr, len(e) + 1))[:-1], np.cumsum(np.bincount(b, hr, len(e) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            wl, wr = weight(gl, hl), weight(G - gl, H - hl)
            gain = gain_of(gl, hl, wl) + gain_of(G - gl, H - hl, wr) - whole
            gain[(n < least_rows) | (len(rows) - n < least_rows) | (monotone[f] * (wr - wl) < 0)] = -np.inf
            if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
        return best

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))])
        gain, f, k, wl, wr = best_split(rows, g, h, low, high) if level < depth else (0, -1, 0, 0, 0)
        if f < 0:
            raw[rows] += nodes[me][4]
            return me
        middle, goes = (wl + wr) / 2, binned[f][rows] <= k
        left_most, right_least = (middle, middle) if monotone[f] > 0 else (high, low)
        left_least, right_most = (middle, middle) if monotone[f] < 0 else (low, high)
        left = grow(rows[goes], g, h, left_least, left_most, level + 1)
        nodes[me][:4] = [f, edges[f][k], left, grow(rows[~goes], g, h, right_least, right_most, level + 1)]
        return me

    if 0 < float(y.sum()) < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), -4.0, 4.0, 0))
    flat = np.array(nodes).reshape(-1, 5)
    as_int = lambda c: flat[:, c].astype(np.int32)
    return Trees(as_int(0), flat[:, 1].copy(), as_int(2), as_int(3), flat[:, 4].copy(), np.array(roots, np.int32), base, depth)
