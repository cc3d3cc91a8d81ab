"""Image and pair measures on DataFrames: Arrow batches in, flat columns out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.functions import geometry, imaging
from sylvameter.session import ship


#: The most pixels of an image that is decoded, and the most files of one ingest batch.
MOST_PIXELS, BATCH_FILES = 80_000_000, 50


def _pixels(data: bytes | None, height, width) -> np.ndarray | None:
    if not data or pd.isna(height) or pd.isna(width) or len(data) != int(height) * int(width) * 3:
        return None
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Rows as columns of objects, so that what a row lacks is null and not NaN."""
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def from_image_source(df: DataFrame) -> DataFrame:
    """(image_id, height, width, data) of Spark's image source, whose channels are blue first; grey ones are tripled."""
    rows = df.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for d, n in zip(pdf["data"], pdf["nChannels"], strict=True):
                a = np.frombuffer(d, np.uint8).reshape(-1, n) if n > 0 else np.empty((0, 3), np.uint8)
                data.append((np.repeat(a, 3, axis=1) if n == 1 else a[:, 2::-1]).tobytes())
            yield pd.DataFrame({"image_id": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "data": data})

    return rows.mapInPandas(turn, "image_id string, height int, width int, data binary")


_SIGNALS = [*(name for name, _, _ in imaging.HUE_BANDS), "water", "sky", "luma_mean", "luma_std", "edges", "cover"]


def measure_images(images: DataFrame) -> DataFrame:
    """(image_id, status, error, phash, signals...) of images (image_id, height, width, data: RGB bytes).

    An image that cannot be read is a row with status REJECTED and the reason, never a failed job.
    """
    schema = "image_id string, status string, error string, phash string, noise double, fft_peak double, moire double, detectable boolean, width int, height int, " + ", ".join(f"{s} double" for s in _SIGNALS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rgb = _pixels(row.data, row.height, row.width)
                base = {"image_id": row.image_id, "status": "INGESTED", "error": None}
                if not pd.isna(row.height) and not pd.isna(row.width) and row.height * row.width > MOST_PIXELS:
                    rows.append(base | {"status": "REJECTED", "error": "too many pixels"})
                elif rgb is None or min(rgb.shape[:2]) < 3:
                    rows.append(base | {"status": "REJECTED", "error": "no readable pixels"})
                else:
                    rows.append(base | {"phash": imaging.perceptual_hash(rgb)} | imaging.forgery_signals(rgb) | imaging.image_signals(rgb))
            yield _frame(rows, names)

    ship(images.sparkSession)
    return images.select("image_id", "height", "width", "data").mapInPandas(run, schema)


def ingest_batches(files: DataFrame, size: int = BATCH_FILES) -> DataFrame:
    """``files`` (path, ...) with batch: numbers that no more than ``size`` files share, in order of the path."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("path"), F.lit(64))).orderBy("path")) - 1
    return files.withColumn("batch", F.concat_ws("-", F.pmod(F.xxhash64("path"), F.lit(64)).cast("string"), F.floor(place / size).cast("string")))


def forgery_action(noise: Column, fft_peak: Column, moire: Column) -> Column:
    """(action, replay): only smoothness may quarantine; a peak or moire asks for review and tells of a replay."""
    smooth = noise < imaging.NOISE_FLOOR
    odd = (fft_peak > imaging.FFT_PEAK) | (moire > imaging.MOIRE)
    action = F.when(smooth, "QUARANTINE_SYNTHETIC").when(odd, "REVIEW_REPLAY").otherwise("NATURAL")
    return F.struct(action.alias("action"), (~smooth & odd).alias("replay"))


def measure_pairs(pairs: DataFrame) -> DataFrame:
    """Canopy change and gains of image pairs (pair_id, height, width, before, after: RGB bytes of one size)."""
    schema = "pair_id string, status string, overlap double, before_px long, after_px long, change_pct double, gain_status string, gains array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                a, b = (_pixels(x, row.height, row.width) for x in (row.before, row.after))
                if a is None or b is None:
                    rows.append({"pair_id": row.pair_id, "status": "SHAPE_MISMATCH"})
                    continue
                gains = imaging.radiometric_gains(a, b)
                fixed = imaging.apply_gains(b, gains["gains"]) if gains["status"] == "OK" else b
                rows.append({"pair_id": row.pair_id, "gain_status": gains["status"], "gains": gains["gains"]} | imaging.canopy_change(a, fixed))
            yield _frame(rows, [c.strip().split(" ")[0] for c in schema.split(",")])

    ship(pairs.sparkSession)
    return pairs.mapInPandas(run, schema)


def measure_gains(pairs: DataFrame) -> DataFrame:
    """(pair_id, status, gains, spread) of image pairs (pair_id, height, width, before, after: RGB bytes of one size).

    Gains bring ``after`` to ``before`` by the medians of what does not change; without readable pixels the status is
    SHAPE_MISMATCH.
    """
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                a, b = (_pixels(x, row.height, row.width) for x in (row.before, row.after))
                found.append({"status": "SHAPE_MISMATCH"} if a is None or b is None else imaging.radiometric_gains(a, b))
            out = _frame(found, ["status", "gains", "spread"])
            out.insert(0, "pair_id", pdf["pair_id"].to_numpy())
            yield out

    ship(pairs.sparkSession)
    return pairs.select("pair_id", "height", "width", "before", "after").mapInPandas(run, f"pair_id {kind}, status string, gains array<double>, spread double")


def register_pairs(points: DataFrame) -> DataFrame:
    """Alignments of correspondences (pair_id, sx, sy, dx, dy, ratio), one group for each pair; the seed is the pair's."""
    schema = (
        "pair_id string, status string, n_matches long, inlier_ratio double, rmse double, condition double, nonplanarity double, "
        "homography array<double>, tps boolean, tps_rms double, trust string"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sx", "sy", "dx", "dy"])
        seed = abs(int.from_bytes(str(pdf["pair_id"].iloc[0]).encode()[-7:], "big"))
        found = geometry.register(pdf[["sx", "sy"]].to_numpy(float), pdf[["dx", "dy"]].to_numpy(float), pdf["ratio"].to_numpy(float), seed)
        return _frame([{"pair_id": pdf["pair_id"].iloc[0]} | found], [c.strip().split(" ")[0] for c in schema.split(",")])

    ship(points.sparkSession)
    return points.groupBy("pair_id").applyInPandas(run, schema)


_MEASURED = (
    "status string, error string, phash string, noise double, fft_peak double, moire double, cover double, canopy_status string, change_pct double, "
    "gain_status string, registration string, inlier_ratio double, trust string"
)


def measure_assets(rows: DataFrame) -> DataFrame:
    """Every image stage of the bulk run in one pass over ``rows`` (asset_id, height, width, data, before, points).

    The hash, the forgery signals and the canopy of ``data`` (RGB bytes); with ``before``, an image of the same size, the
    change of the canopy after gains; with ``points`` (array of sx, sy, dx, dy, ratio) the registration. A stage without
    its input has nulls, an image that cannot be read is REJECTED with the reason, and no row fails the job.
    """
    names = [c.split()[0] for c in _MEASURED.split(", ")]

    def one(row) -> dict:
        rgb = _pixels(row.data, row.height, row.width)
        if not pd.isna(row.height) and not pd.isna(row.width) and row.height * row.width > MOST_PIXELS:
            return {"status": "REJECTED", "error": "too many pixels"}
        if rgb is None or min(rgb.shape[:2]) < 3:
            return {"status": "REJECTED", "error": "no readable pixels"}
        mask = imaging.canopy_mask(rgb)
        out = {"status": "INGESTED", "phash": imaging.perceptual_hash(rgb), "cover": float(mask[0].mean()) if mask else 0.0} | imaging.forgery_signals(rgb)
        before = _pixels(row.before, row.height, row.width)
        if before is not None:
            gains = imaging.radiometric_gains(before, rgb)
            change = imaging.canopy_change(before, imaging.apply_gains(rgb, gains["gains"]) if gains["status"] == "OK" else rgb)
            out |= {"gain_status": gains["status"], "canopy_status": change["status"], "change_pct": change["change_pct"]}
        if row.points is not None and len(row.points):
            p = np.array([[x[k] for k in ("sx", "sy", "dx", "dy", "ratio")] for x in row.points], float)
            found = geometry.register(p[:, :2], p[:, 2:4], p[:, 4], zlib.crc32(str(row.asset_id).encode()))
            out |= {"registration": found["status"], "inlier_ratio": found["inlier_ratio"], "trust": found["trust"]}
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = _frame([one(row) for row in pdf.itertuples(index=False)], names)
            found.insert(0, "asset_id", pdf["asset_id"].to_numpy())
            yield found

    ship(rows.sparkSession)
    kind = rows.schema["asset_id"].dataType.simpleString()
    return rows.select("asset_id", "height", "width", "data", "before", "points").mapInPandas(run, f"asset_id {kind}, {_MEASURED}")
