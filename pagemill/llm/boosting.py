"""Gradient-boosted trees for two classes, in numpy, with isotonic calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Log-loss boosting of depth-limited trees on binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self.rate * self._walk(tree, b)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int16)

    def _grow(self, b, g, h):
        """Nodes in heap order: (feature or -1, bin, value)."""
        size = 2 ** (self.depth + 1) - 1
        feat, cut, val = np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            r = rows.get(node)
            if r is None:
                continue
            gs, hs = g[r].sum(), h[r].sum()
            val[node] = gs / (hs + 1.0)
            if 2 * node + 2 >= size or len(r) < 2 * self.least:
                continue
            best = (1e-6, None)
            for j in range(b.shape[1]):
                n = len(self.edges[j]) + 1
                if n < 2:
                    continue
                k = b[r, j]
                cg, ch, cn = (np.cumsum(np.bincount(k, w, n))[:-1] for w in (g[r], h[r], None))
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                gain[(cn < self.least) | (len(r) - cn < self.least)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (j, at))
            if best[1]:
                feat[node], cut[node] = best[1]
                left = b[r, feat[node]] <= cut[node]
                rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
        return feat, cut, val

    def _walk(self, tree, b):
        feat, cut, val = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feat[node]
            inner = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return val[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + self.rate * sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (least score, probability) of each step."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([s, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, t2, n2 = blocks.pop()
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrated(score: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at = np.clip(np.searchsorted(steps[0], score, "right") - 1, 0, len(steps[0]) - 1)
    return steps[1][at]
