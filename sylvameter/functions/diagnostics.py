"""Diagnostics that must not feed a measurement: a matched image has lost the change that is to be measured."""

from __future__ import annotations

import numpy as np


def match_histogram(source: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Each channel of ``source`` mapped to the least value of ``reference`` with as large a share below it."""
    out = np.empty_like(source)
    for c in range(source.shape[2]):
        cdf = [np.bincount(x[..., c].ravel(), minlength=256).cumsum() / x[..., c].size for x in (source, reference)]
        out[..., c] = np.searchsorted(cdf[1], cdf[0] - 1e-12).clip(0, 255).astype(np.uint8)[source[..., c]]
    return out
