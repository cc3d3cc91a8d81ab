"""Image measures in numpy. Images are RGB arrays of bytes (height, width, 3)."""

from __future__ import annotations

import numpy as np

#: Thresholds of the measures.
MIN_CONTRAST, MIN_OVERLAP, MIN_BASELINE = 0.02, 0.35, 400
NOISE_FLOOR, FFT_PEAK, MOIRE = 80.0, 3.8, 4.2
FFT_MASK = 20
GAIN_NOOP, GAIN_MOST = 0.02, 3.0
HUE_BANDS = (("brown", 0, 45), ("yellow", 45, 75), ("green", 75, 165), ("cyan", 165, 195), ("blue", 195, 270), ("magenta", 270, 360))


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def green_leaf_index(rgb: np.ndarray) -> np.ndarray:
    """(2G - R - B) / (2G + R + B), held to -1 and 1; brightness does not matter to it."""
    r, g, b = np.moveaxis(rgb.astype(np.float64), -1, 0)
    return np.clip((2 * g - r - b) / (2 * g + r + b + 1e-7), -1, 1)


def to_byte(index: np.ndarray) -> np.ndarray:
    return ((index + 1) * 127.5).astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    """The byte threshold with the largest variance between classes; the lowest of equals."""
    h = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    w, s = h.cumsum(), (h * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * w - s * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def _shifted(a: np.ndarray, radius: int, fill: float) -> np.ndarray:
    p = np.pad(a, radius, constant_values=fill)
    return np.lib.stride_tricks.sliding_window_view(p, (2 * radius + 1, 2 * radius + 1))


def _ellipse(size: int) -> np.ndarray:
    y, x = np.mgrid[:size, :size] - size // 2
    r = size // 2
    return np.abs(x) <= np.round(r * np.sqrt(np.maximum(0, 1 - (y / max(r, 1)) ** 2)))


def opened_and_closed(mask: np.ndarray, size: int = 5) -> np.ndarray:
    """A mask without specks and pinholes: opening and then closing by an ellipse."""
    e, r = _ellipse(size), size // 2
    erode = lambda m: (_shifted(m, r, True) | ~e).all(axis=(2, 3))
    dilate = lambda m: (_shifted(m, r, False) & e).any(axis=(2, 3))
    return erode(dilate(dilate(erode(mask))))


def canopy_mask(rgb: np.ndarray, offset: float = 0.0) -> tuple[np.ndarray, float] | None:
    """(mask, threshold) of vegetation, or None where the image has too little contrast to tell."""
    index = green_leaf_index(rgb)
    if index.std() < MIN_CONTRAST:
        return None
    value = to_byte(index)
    cut = otsu(value)
    return opened_and_closed(value > cut + offset), cut / 127.5 - 1


def valid_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixels that are no empty border in either image."""
    sums = [x.astype(np.int64).sum(axis=2) for x in (a, b)]
    return np.logical_and.reduce([(s > 10) & (s <= 765) for s in sums])


def canopy_change(before: np.ndarray, after: np.ndarray) -> dict:
    """status, overlap, pixels before and after, and the change in per cent, which is None unless the status is OK."""
    out = {"status": "OK", "overlap": 0.0, "before_px": 0, "after_px": 0, "change_pct": None}
    if before.shape != after.shape:
        return out | {"status": "SHAPE_MISMATCH"}
    valid = valid_overlap(before, after)
    out["overlap"] = float(valid.mean())
    if out["overlap"] < MIN_OVERLAP:
        return out | {"status": "INSUFFICIENT_OVERLAP"}
    masks = canopy_mask(before), canopy_mask(after)
    if None in masks:
        return out | {"status": "INSUFFICIENT_CONTRAST"}
    out["before_px"], out["after_px"] = (int((m[0] & valid).sum()) for m in masks)
    if out["before_px"] < MIN_BASELINE:
        return out | {"status": "BASELINE_TOO_SMALL"}
    return out | {"change_pct": (out["after_px"] - out["before_px"]) / out["before_px"] * 100}


def _neighbours(gray: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    p = np.pad(gray, 1, mode="reflect")
    h, w = gray.shape
    return sum(k * p[i : i + h, j : j + w] for i, row in enumerate(kernel) for j, k in enumerate(row) if k)


def gradient(gray: np.ndarray) -> np.ndarray:
    gx = _neighbours(gray, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    gy = _neighbours(gray, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    return np.hypot(gx, gy)


def forgery_signals(rgb: np.ndarray) -> dict:
    """noise: variance of the Laplacian. fft_peak: peak over mean of the spectrum without its middle. moire: spread of the gradient."""
    gray = luma(rgb)
    magnitude = 20 * np.log(np.abs(np.fft.fftshift(np.fft.fft2(gray))) + 1e-7)
    h, w = gray.shape
    if h > 2 * FFT_MASK and w > 2 * FFT_MASK:
        magnitude[h // 2 - FFT_MASK : h // 2 + FFT_MASK, w // 2 - FFT_MASK : w // 2 + FFT_MASK] = 0
    g = gradient(gray)
    return {
        "noise": float(_neighbours(gray, [[0, 1, 0], [1, -4, 1], [0, 1, 0]]).var()),
        "fft_peak": float(magnitude.max() / (magnitude.mean() + 1e-7)),
        "moire": float(g.std() / g.mean()) if g.mean() > 0 else 0.0,
    }


def _resize(gray: np.ndarray, size: int) -> np.ndarray:
    """Area average to a square; every pixel counts by how much of it a cell covers."""
    def weights(n: int) -> np.ndarray:
        edge = np.linspace(0, n, size + 1)
        low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
        w = np.clip(high - low, 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(gray.shape[0]) @ gray @ weights(gray.shape[1]).T


def perceptual_hash(rgb: np.ndarray) -> str:
    """64-bit hash of 16 hex digits: the lowest cosine coefficients of a 32 x 32 image against their median."""
    small = _resize(luma(rgb), 32)
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / 64)
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def largest_region(mask: np.ndarray) -> int:
    """Pixels of the largest 4-connected region, by spreading the least label."""
    if not mask.any():
        return 0
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 2
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        least = np.minimum.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        new = np.where(mask, least, 0)
        new = np.where(mask, np.minimum(new, np.concatenate(([0], new.ravel()))[new]), 0) if mask.any() else new
        if np.array_equal(new, label):
            return int(np.bincount(label[mask]).max())
        label = new


def local_spread(gray: np.ndarray, size: int = 9) -> np.ndarray:
    """Standard deviation in a square around each pixel, from running sums."""
    r = size // 2
    p = np.pad(gray.astype(np.float64), r + 1, mode="edge")

    def box(a: np.ndarray) -> np.ndarray:
        c = a.cumsum(0).cumsum(1)
        return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size])[: gray.shape[0], : gray.shape[1]] / size**2

    return np.sqrt(np.maximum(box(p * p) - box(p) ** 2, 0))


def image_signals(rgb: np.ndarray) -> dict:
    """The scalars that tag rules look at."""
    x = rgb.astype(np.float64)
    top, low = x.max(axis=2), x.min(axis=2)
    span = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) * 60
    sat = np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0)
    vivid, gray = sat > 40, luma(rgb)
    smooth = local_spread(gray)
    water = (hue >= 165) & (hue < 270) & (sat > 45) & (smooth < 10)
    region = largest_region(water)
    third = slice(0, max(1, rgb.shape[0] // 3))
    mask = canopy_mask(rgb)
    out = {name: float(((hue >= a) & (hue < z) & vivid).mean()) for name, a, z in HUE_BANDS}
    edge = gradient(gray)
    return out | {
        "water": float(region / water.size) if region >= 1500 else 0.0,
        "sky": float(((top[third] > 140) & (sat[third] < 70) & (smooth[third] < 18)).sum() / sat.size),
        "luma_mean": float(gray.mean()), "luma_std": float(gray.std()), "edges": float((edge > 120).mean()),
        "detectable": mask is not None, "cover": float(mask[0].mean()) if mask else 0.0, "width": rgb.shape[1], "height": rgb.shape[0],
    }


def reference_pixels(rgb: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Pixels taken as unchanging: a mask of 32 or more, else the brightest tenth, else all."""
    if mask is not None and mask.shape == rgb.shape[:2] and mask.sum() >= 32:
        return mask
    gray = luma(rgb)
    bright = gray >= np.percentile(gray, 90)
    return bright if bright.sum() >= 32 else np.ones(gray.shape, bool)


def radiometric_gains(before: np.ndarray, after: np.ndarray, mask: np.ndarray | None = None) -> dict:
    """Channel gains that bring ``after`` to ``before``: status OK, NOOP, or REFUSED beyond a factor of three."""
    a = np.median(before[reference_pixels(before, mask)], axis=0)
    b = np.median(after[reference_pixels(after, mask)], axis=0)
    if (b <= 0).any():
        return {"status": "REFUSED", "gains": None, "spread": None}
    gains = a / b
    status = "REFUSED" if ((gains > GAIN_MOST) | (gains < 1 / GAIN_MOST)).any() else "NOOP" if (abs(gains - 1) <= GAIN_NOOP).all() else "OK"
    return {"status": status, "gains": gains.tolist() if status != "REFUSED" else None, "spread": float(gains.max() - gains.min())}


def apply_gains(rgb: np.ndarray, gains: list[float]) -> np.ndarray:
    return np.clip(np.rint(rgb * np.asarray(gains)), 0, 255).astype(np.uint8)
