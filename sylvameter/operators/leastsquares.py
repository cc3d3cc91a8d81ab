"""Least squares by group from moments: sums that add up over partitions, so that no group is ever held together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the spread below which the points count as lying on one line.
_FLAT = 1e-12


def _solved(u: str) -> tuple[Column, Column]:
    """Slopes of the best plane for ``u`` over x and y; along their line if x and y lie on one, flat if on one point."""
    xx, yy, xy, det, spread = (F.col(c) for c in ("xx", "yy", "xy", "det", "spread"))
    xu, yu = F.col(f"x{u}"), F.col(f"y{u}")
    plane = det > _FLAT * spread * spread
    a = F.when(plane, (yy * xu - xy * yu) / det).when(spread > 0, xu / spread).otherwise(0.0)
    b = F.when(plane, (xx * yu - xy * xu) / det).when(spread > 0, yu / spread).otherwise(0.0)
    return a, b


def affine_fit(points: DataFrame, *keys: str) -> DataFrame:
    """The best affine map (x, y) -> (u, v) of each group of ``points`` and what it leaves.

    Returns ``keys``, n, the map as u = ux * x + uy * y + u0 and v = vx * x + vy * y + v0, and rms, the root mean square
    of what is left: infinite for fewer than three points, null for none without nulls. Rows with a null take no part.
    Variances and covariances are merged as they are, which loses less than sums of squares do.
    """
    names = ("x", "y", "u", "v")
    sound = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull())
    means = [F.avg(c).alias(f"mean_{c}") for c in names]
    squares = [F.var_pop(c).alias(c + c) for c in names]
    products = [F.covar_pop(a, b).alias(a + b) for a, b in (("x", "y"), ("x", "u"), ("y", "u"), ("x", "v"), ("y", "v"))]
    moments = sound.groupBy(*keys).agg(F.count("*").alias("n"), *means, *squares, *products)
    moments = moments.withColumn("spread", F.col("xx") + F.col("yy")).withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    slopes = {f"{u}{axis}": c for u in ("u", "v") for axis, c in zip(("x_", "y_"), _solved(u), strict=True)}
    fitted = moments.withColumns(slopes)
    left = sum((F.col(u + u) - F.col(f"{u}x_") * F.col(f"x{u}") - F.col(f"{u}y_") * F.col(f"y{u}") for u in ("u", "v")), F.lit(0.0))
    offsets = [(F.col(f"mean_{u}") - F.col(f"{u}x_") * F.col("mean_x") - F.col(f"{u}y_") * F.col("mean_y")).alias(f"{u}0") for u in ("u", "v")]
    rms = F.when(F.col("n") < 3, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(left, F.lit(0.0))))
    return fitted.select(*keys, "n", *[F.col(f"{u}{axis}_").alias(f"{u}{axis}") for u in ("u", "v") for axis in ("x", "y")], *offsets, rms.alias("rms"))
