"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of a fixed depth over quantile bins. Each tree: split features, split bins and leaf values, by heap place."""

    edges: list[np.ndarray]
    depth: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for features, cuts, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, features[at]] > cuts[at])
            total += leaves[at - (2**self.depth - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, most_bins: int = 48, shrink: float = 1.0) -> Boosted:
    """Fit by second-order logistic boosting; ties between splits go to the first feature and bin."""
    marks = np.linspace(0, 1, most_bins + 1)[1:-1]
    model = Boosted([np.unique(np.quantile(x[:, j], marks)) for j in range(x.shape[1])], depth)
    p = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
    model.base = float(np.log(p / (1 - p)))
    b, f, k = model.bins(x), np.full(len(y), model.base), most_bins + 1
    columns = np.arange(x.shape[1]) * k
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-f))
        g, h = w * (prob - y), w * prob * (1 - prob)
        features, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, k, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            place = ((at - first)[:, None] * (x.shape[1] * k) + columns + b).ravel()
            shape = (2**level, x.shape[1], k)
            size = int(np.prod(shape))
            gs = np.bincount(place, np.repeat(g, x.shape[1]), size).reshape(shape).cumsum(axis=2)
            hs = np.bincount(place, np.repeat(h, x.shape[1]), size).reshape(shape).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + shrink) + (gt - gs) ** 2 / (ht - hs + shrink) - gt**2 / (ht + shrink)
            for node in range(2**level):
                best = int(gain[node].argmax())
                if gain[node].flat[best] > 1e-9:
                    features[first + node], cuts[first + node] = divmod(best, k)
            at = 2 * at + 1 + (b[np.arange(len(y)), features[at]] > cuts[at])
        leaf = at - (2**depth - 1)
        leaves = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + shrink)
        f += leaves[leaf]
        model.trees.append((features, cuts, leaves))
    return model


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, by pooling adjacent violators; equal scores are one point."""
    s, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse, w)
    mean = np.bincount(inverse, w * y) / weight
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for m, n, at in zip(mean, weight, s, strict=True):
        blocks.append([m, n, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, n2, _, last = blocks.pop()
            m1, n1, begin, _ = blocks.pop()
            blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, begin, last])
    xs = np.array([v for block in blocks for v in block[2:]])
    ys = np.array([block[0] for block in blocks for _ in range(2)])
    return xs, ys
