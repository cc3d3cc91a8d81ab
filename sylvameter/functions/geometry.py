"""Registration geometry in numpy, from point correspondences (n, 2) to a judged alignment."""

from __future__ import annotations

import numpy as np

#: Matching, trust and refinement thresholds.
RATIO, MIN_MATCHES, MIN_POINTS, MOST_CONDITION = 0.75, 15, 20, 1e6
INLIER_PX, ROUNDS = 3.0, 2000
#: Samples of a consensus that are judged at once.
BLOCK = 250
TPS_BELOW, TPS_PARALLAX, TPS_GAIN = 0.70, 1.5, 0.20
USABLE, TRUSTED = 0.60, 0.70
PIXEL_BUDGET = 1920 * 1080


def detection_scale(width: int, height: int, budget: int = PIXEL_BUDGET) -> float:
    return max(1.0, float(np.sqrt(width * height / budget)))


def affine_residual(src: np.ndarray, dst: np.ndarray) -> float:
    """Root mean square of what the best affine map leaves: how far the points are from one plane."""
    if len(src) < 3:
        return float("inf")
    design = np.column_stack([src, np.ones(len(src))])
    rest = dst - design @ np.linalg.lstsq(design, dst, rcond=None)[0]
    return float(np.sqrt((rest**2).sum(axis=1).mean()))


def _normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = p.mean(axis=0)
    scale = np.sqrt(2) / max(1e-12, np.linalg.norm(p - centre, axis=1).mean())
    t = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
    return (p - centre) * scale, t


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The direct linear solution on normalised points."""
    (a, ta), (b, tb) = _normal(src), _normal(dst)
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    one, nil = np.ones(len(a)), np.zeros(len(a))
    rows = np.concatenate([np.column_stack([-x, -y, -one, nil, nil, nil, u * x, u * y, u]), np.column_stack([nil, nil, nil, -x, -y, -one, v * x, v * y, v])])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def exact_homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The homographies of many samples of four points (m, 4, 2) at once, by the frames that the points span.

    Three of the four on a line span no frame; what comes of such a sample agrees with no other points.
    """

    def frames(p: np.ndarray) -> np.ndarray:
        a, b, c, d = (np.concatenate([p[:, i], np.ones((len(p), 1))], axis=1) for i in range(4))
        det = lambda x, y, z: (x * np.cross(y, z)).sum(axis=1)[:, None]
        return np.stack([a * det(d, b, c), b * det(a, d, c), c * det(a, b, d)], axis=2)

    x, y, z = np.moveaxis(frames(src), 2, 0)
    return frames(dst) @ np.stack([np.cross(y, z), np.cross(z, x), np.cross(x, y)], axis=1)


def robust_homography(src: np.ndarray, dst: np.ndarray, seed: int) -> tuple[np.ndarray | None, np.ndarray]:
    """(h, inliers) by seeded consensus over samples of four, refitted on the largest set. Samples are judged by blocks."""
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    (a, _), (b, tb) = _normal(src), _normal(dst)
    points = np.column_stack([a, np.ones(len(a))])
    for start in range(0, ROUNDS, BLOCK):
        picks = np.argpartition(rng.random((min(BLOCK, ROUNDS - start), len(src))), 3, axis=1)[:, :4]
        q = points @ exact_homographies(a[picks], b[picks]).transpose(0, 2, 1)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            near = ((q[..., :2] / q[..., 2:] - b) ** 2).sum(axis=2) < (INLIER_PX * tb[0, 0]) ** 2
        counts = near.sum(axis=1)
        first = int(counts.argmax())
        if counts[first] > best.sum():
            best = near[first]
            if best.mean() > 0.999:
                break
    if best.sum() < 4:
        return None, best
    h = homography(src[best], dst[best])
    return h, best if h is None else np.linalg.norm(project(h, src) - dst, axis=1) < INLIER_PX


def condition(h: np.ndarray) -> float:
    s = np.linalg.svd(h, compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] > 0 else float("inf")


def _kernel(d2: np.ndarray) -> np.ndarray:
    return np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)), 0.0)


def thin_plate(src: np.ndarray, dst: np.ndarray, ridge: float = 1e-8):
    """A function that maps points as a thin plate spline through the control points does."""
    centre, scale = src.mean(axis=0), max(1e-9, float(src.std()))
    p = (src - centre) / scale
    n = len(p)
    k = _kernel(((p[:, None] - p[None]) ** 2).sum(axis=2)) + ridge * np.eye(n)
    a = np.column_stack([np.ones(n), p])
    left = np.block([[k, a], [a.T, np.zeros((3, 3))]])
    w = np.linalg.lstsq(left, np.concatenate([dst, np.zeros((3, 2))]), rcond=None)[0]

    def apply(q: np.ndarray) -> np.ndarray:
        r = (q - centre) / scale
        u = _kernel(((r[:, None] - p[None]) ** 2).sum(axis=2))
        return u @ w[:n] + np.column_stack([np.ones(len(r)), r]) @ w[n:]

    return apply


def displacement_field(apply, width: int, height: int, rows: int = 24, columns: int = 32) -> np.ndarray:
    """Where a coarse grid of the image goes, (rows, columns, 2)."""
    y, x = np.meshgrid(np.linspace(0, height - 1, rows), np.linspace(0, width - 1, columns), indexing="ij")
    grid = np.column_stack([x.ravel(), y.ravel()])
    return (apply(grid) - grid).reshape(rows, columns, 2)


def register(src: np.ndarray, dst: np.ndarray, ratio: np.ndarray | None = None, seed: int = 0) -> dict:
    """status, trust, homography and measures of a pair; failures say why and carry no number."""
    out = {"status": "OK", "n_matches": 0, "inlier_ratio": None, "rmse": None, "condition": None, "nonplanarity": None, "homography": None, "tps": False, "tps_rms": None, "trust": "not_trusted"}
    if len(src) < MIN_POINTS:
        return out | {"status": "TOO_FEW_POINTS"}
    kept = np.ones(len(src), bool) if ratio is None else ratio < RATIO
    src, dst = src[kept], dst[kept]
    out["n_matches"] = int(len(src))
    if len(src) < MIN_MATCHES:
        return out | {"status": "TOO_FEW_MATCHES"}
    h, near = robust_homography(src, dst, seed)
    if h is None:
        return out | {"status": "NO_HOMOGRAPHY"}
    share = float(near.mean())
    rest = np.linalg.norm(project(h, src[near]) - dst[near], axis=1)
    plane = affine_residual(src, dst)
    out |= {"inlier_ratio": share, "rmse": float(np.sqrt((rest**2).mean())), "condition": condition(h), "nonplanarity": plane, "homography": h.ravel().tolist()}
    if out["condition"] > MOST_CONDITION:
        return out | {"status": "ILL_CONDITIONED", "homography": None}
    if share < TPS_BELOW and plane > TPS_PARALLAX:
        fit = thin_plate(src, dst)
        rms = float(np.sqrt(((fit(src) - dst) ** 2).sum(axis=1).mean()))
        out |= {"tps_rms": rms, "tps": rms <= plane * (1 - TPS_GAIN)}
    out["trust"] = "trusted" if share >= TRUSTED else "usable" if share >= USABLE else "not_trusted"
    return out | ({"status": "BELOW_FLOOR"} if share < USABLE and not out["tps"] else {})
