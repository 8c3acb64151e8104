"""Small boosted trees for weighted rows: binned features, logistic loss, isotonic calibration."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """``rounds`` trees of ``depth`` levels; every node splits one feature at one edge."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, smooth: float = 2.0):
        self.rounds, self.depth, self.rate, self.smooth = rounds, depth, rate, smooth
        self.base, self.trees, self.edges = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [self._quantiles(x[:, f], w) for f in range(x.shape[1])]
        share = ((w * y).sum() + 1) / (w.sum() + 2)
        self.base = float(np.log(share / (1 - share)))
        cells, margin = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(cells, w * (p - y), w * p * (1 - p))
            self.trees.append(tree)
            margin += self._apply(tree, cells)
        return self

    @staticmethod
    def _quantiles(values: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Edges are values of rows; few different ones are all edges, so rare values keep a cut of their own."""
        known = np.unique(values)
        if len(known) < BINS:
            return known
        order = np.argsort(values, kind="stable")
        at = np.searchsorted(np.cumsum(w[order]), np.linspace(0, 1, BINS)[1:-1] * w.sum(), side="left")
        return np.unique(values[order][np.clip(at, 0, len(order) - 1)])

    def _grow(self, cells: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        nodes, node = [], np.zeros(len(g), np.int64)
        for level in range(self.depth):
            features, cuts = [], []
            for k in range(1 << level):
                own = node == k
                best = (0.0, 0, BINS)
                gain_all = g[own].sum() ** 2 / (h[own].sum() + self.smooth)
                for f in range(cells.shape[1]):
                    gs = np.bincount(cells[own, f], g[own], minlength=BINS).cumsum()
                    hs = np.bincount(cells[own, f], h[own], minlength=BINS).cumsum()
                    gain = gs ** 2 / (hs + self.smooth) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.smooth) - gain_all
                    c = int(np.argmax(gain))
                    if gain[c] > best[0] + 1e-9:
                        best = (float(gain[c]), f, c)
                features.append(best[1])
                cuts.append(best[2])
            nodes.append((np.array(features), np.array(cuts)))
            node = 2 * node + (cells[np.arange(len(g)), nodes[-1][0][node]] > nodes[-1][1][node])
        gs = np.bincount(node, g, minlength=1 << self.depth)
        hs = np.bincount(node, h, minlength=1 << self.depth)
        return nodes, -self.rate * gs / (hs + self.smooth)

    def _apply(self, tree: tuple, cells: np.ndarray) -> np.ndarray:
        nodes, leaves = tree
        node = np.zeros(len(cells), np.int64)
        for features, cuts in nodes:
            node = 2 * node + (cells[np.arange(len(cells)), features[node]] > cuts[node])
        return leaves[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        cells = self._binned(x)
        return self.base + sum((self._apply(t, cells) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool adjacent violators: margin to probability."""

    def fit(self, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> Isotonic:
        levels, at = np.unique(margin, return_inverse=True)  # equal margins are one block
        total, right = np.bincount(at, w), np.bincount(at, w * y)
        blocks: list[list[float]] = []
        for x, n, s in zip(levels.tolist(), total.tolist(), right.tolist(), strict=True):
            blocks.append([s, n, x])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, _ = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += n
        self.starts = np.array([b[2] for b in blocks])
        self.values = np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks])
        return self

    def predict(self, margin: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(margin))
        return self.values[np.clip(np.searchsorted(self.starts, margin, side="right") - 1, 0, None)]
