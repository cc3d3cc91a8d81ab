"""A forest of BK-trees over 64-bit fingerprints, built and searched level by level in numpy.

A node's children are keyed by their integer Hamming distance to it. All trees of a task live in one set of arrays, so
that one numpy step moves every pending fingerprint of every tree down one level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_KEYS = 65  # distances 0 to 64


class Forest:
    """BK-trees, one for each shard. ``values`` are distinct within a shard."""

    def __init__(self, shards: np.ndarray, values: np.ndarray) -> None:
        self.values = values
        _, first, self.shard = np.unique(shards, return_index=True, return_inverse=True)
        self.sizes = np.bincount(self.shard, minlength=len(first))
        self.roots = first
        pending = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        at = self.roots[self.shard[pending]]
        keys, nodes = [], []
        while len(pending):
            edge = at * _KEYS + np.bitwise_count(values[pending] ^ values[at])
            key, lead, inverse = np.unique(edge, return_index=True, return_inverse=True)
            child = pending[lead]  # the first on an edge becomes its node, as in one-by-one insertion
            keys.append(key)
            nodes.append(child)
            down = np.ones(len(pending), bool)
            down[lead] = False
            at = child[inverse][down]
            pending = pending[down]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.nodes = self.keys[order], self.nodes[order]

    def within(self, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i of ``asks``, j) of the same shard at most ``radius`` apart, i itself left out."""
        ask, node = asks, self.roots[self.shard[asks]]
        left, right = [], []
        while len(ask):
            d = np.bitwise_count(self.values[ask] ^ self.values[node]).astype(np.int64)
            hit = (d <= radius) & (ask != node)
            left.append(ask[hit])
            right.append(node[hit])
            low = np.searchsorted(self.keys, node * _KEYS + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * _KEYS + np.minimum(d + radius, _KEYS - 1), "right")
            n = high - low
            ask = np.repeat(ask, n)
            step = np.arange(len(ask)) - np.repeat(np.cumsum(n) - n, n)
            node = self.nodes[np.repeat(low, n) + step]
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *left]), np.concatenate([empty, *right])

    def blocks(self, asks: np.ndarray, most_pairs: int = 4_000_000) -> Iterator[np.ndarray]:
        """Runs of ``asks`` whose trees cannot give more than about ``most_pairs`` visits at once."""
        total = np.cumsum(self.sizes[self.shard[asks]])
        cuts = np.searchsorted(total, np.arange(most_pairs, total[-1], most_pairs)) + 1 if len(asks) else []
        return (x for x in np.split(asks, np.unique(cuts)) if len(x))


def spanning_links(shards: np.ndarray, values: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """At most one link (value, value) for each fingerprint of a shard, that join what ``radius`` joins."""
    forest = Forest(shards, values)
    parent = np.arange(len(values))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    for block in forest.blocks(np.flatnonzero(asks)):
        i, j = forest.within(block, radius)
        while len(i):
            i, j = root(i), root(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        parent = root(np.arange(len(values)))
    child = np.flatnonzero(parent != np.arange(len(values)))
    return values[child], values[parent[child]]
