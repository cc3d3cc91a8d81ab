"""Hashed character n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the mixing steps.
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of what is not a letter are one space, as are both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = (c >= 97) & (c <= 122) | (c >= 0xC0) & (c != 0xD7) & (c != 0xF7) | np.isin(c, (0xAA, 0xB5, 0xBA))
    out = np.where(letter, c, np.uint32(32))
    space = out == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = out[keep]
    return np.concatenate(([np.uint32(32)], out, [np.uint32(32)])).astype(np.uint32) if len(out) else out


def batch_grams(texts: list[np.ndarray], orders: tuple[int, ...], buckets: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of n codes that lies in one of ``texts`` (as ``codes`` gives them), for each order n.

    Rows ascend within a part. A part has the runs that start in ``most`` codes in a row, so memory does not grow with
    the texts, and each run is in exactly one part. ``buckets`` is a power of two.
    """
    whole = np.concatenate([*texts, np.empty(0, np.uint32)])
    ends = np.cumsum([len(t) for t in texts])
    for at in range(0, len(whole), most):
        c = whole[at : at + most + max(orders) - 1]
        starts = np.arange(at, min(at + most, len(whole)))
        rows = np.searchsorted(ends, starts, "right")
        room = ends[rows] - starts
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(orders) + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * _A
            h ^= h >> np.uint32(15)
            if n in orders:
                own = h[: len(starts)]
                inside = np.flatnonzero(room[: len(own)] >= n)
                mixed = (own[inside] + np.uint32(n)) * _B
                yield rows[inside], (mixed >> np.uint32(16) ^ mixed) & np.uint32(buckets - 1)
