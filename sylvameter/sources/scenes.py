"""Synthetic scenes rendered in the tasks that need them: soil with a band of vegetation, before and after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.session import ship

#: Colours of soil and of vegetation.
SOIL, LEAVES = (150, 110, 70), (60, 150, 50)


def scene(seed: int, height: int, width: int, green: int, spread: float = 6.0) -> np.ndarray:
    """RGB bytes with the first ``green`` columns vegetation; the same for the same seed."""
    rng = np.random.default_rng(seed)
    image = np.full((height, width, 3), SOIL, np.float64)
    image[:, :green] = LEAVES
    return np.clip(image + rng.normal(0, spread, image.shape), 0, 255).astype(np.uint8)


def render(df: DataFrame, height: int, width: int) -> DataFrame:
    """``df`` (asset_id, seed, green, green_before) as images: (asset_id, height, width, data, before).

    A null or negative ``green`` gives bytes that are no image, as a broken upload would. Column ``points``, if there is
    one, is passed on: a join with the images would move all their bytes, or broadcast them.
    """
    points = [c for c in df.columns if c == "points"]
    kind = df.schema["asset_id"].dataType.simpleString()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [(b"broken", None) if pd.isna(g) or g < 0 else tuple(scene(int(s), height, width, int(x)).tobytes() for x in (g, b)) for s, g, b in zip(pdf["seed"], pdf["green"], pdf["green_before"], strict=True)]
            yield pd.DataFrame({"asset_id": pdf["asset_id"], "height": height, "width": width, "data": [x[0] for x in both], "before": [x[1] for x in both]} | {c: pdf[c] for c in points})

    ship(df.sparkSession)
    kinds = [f"asset_id {kind}, height int, width int, data binary, before binary", *[f"points {df.schema[c].dataType.simpleString()}" for c in points]]
    return df.select("asset_id", "seed", "green", "green_before", *points).mapInPandas(draw, ", ".join(kinds))


def correspondences(number: Column, side: int = 6, stray: int = 7) -> Column:
    """array<struct<sx, sy, dx, dy, ratio>>: a grid of points moved as one, of which every ``stray``-th went elsewhere."""
    places = F.sequence(F.lit(0), F.lit(side * side - 1))

    def point(i: Column) -> Column:
        x, y = (i % side).cast("double") * 20, F.floor(i / side).cast("double") * 20
        off = F.when(i % stray == 0, 60.0 + i.cast("double")).otherwise(0.0)
        return F.struct(x.alias("sx"), y.alias("sy"), (x + number % 5 + off).alias("dx"), (y + number % 7 - off).alias("dy"), F.lit(0.5).alias("ratio"))

    return F.transform(places, point)
