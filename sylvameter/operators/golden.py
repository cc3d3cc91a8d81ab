"""Golden vectors of the shadow check: captures whose verdict is known, made by looking for the instant that they need.

A day is scanned every five minutes. All scans are one explosion of instants with the sun's place beside, reduced by
``min_by`` and ``max_by``, so any number of places is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.functions import solar

#: Minutes between instants; degrees a shadow may be off in a genuine capture, and must be short of the
#: tolerance; least error of a wrong clock and of a wrong place; least height of the sun for two places to be compared.
STEP, JITTER, MARGIN, CLOCK_ERROR, PLACE_ERROR, LEAST_SUN = 5, 2.0, 5.0, 90.0, 45.0, 10.0


def day_scan(places: DataFrame, day: str, step: int = STEP) -> DataFrame:
    """``places`` (place, latitude, longitude, ...) at every instant of a UTC day, with sun_azimuth and sun_elevation."""
    start = F.unix_date(F.to_date(F.lit(day))).cast("long") * 86_400  # in UTC, whatever the time zone of the session
    minutes = F.explode(F.sequence(F.lit(0), F.lit(24 * 60 - step), F.lit(step)))
    instants = places.withColumn("__m", minutes).withColumn("ts", F.timestamp_seconds(start + F.col("__m") * 60)).drop("__m")
    return solar.with_sun(instants)


def noon(places: DataFrame, day: str) -> DataFrame:
    """(place, ts, sun_elevation): the instant of the highest sun, the first of equal ones."""
    order = F.struct(F.col("sun_elevation").alias("e"), (-F.unix_seconds("ts")).alias("t"))
    return day_scan(places, day).groupBy("place").agg(F.max_by("ts", order).alias("ts"), F.max("sun_elevation").alias("sun_elevation"))


def at_height(places: DataFrame, day: str, target: float = 5.0, setting: bool = False) -> DataFrame:
    """(place, ts, sun_elevation): where the sun is nearest above ``target``; with ``setting`` after 12 UTC if it is up then.

    A place whose sun does not reach the target has no row.
    """
    up = day_scan(places, day).where(F.col("sun_elevation") >= target)
    late = F.unix_seconds("ts") % 86_400 > 12 * 3_600
    order = F.struct((F.lit(setting) & ~late).cast("int").alias("l"), (F.col("sun_elevation") - target).alias("off"), F.unix_seconds("ts").alias("t"))
    best = up.groupBy("place").agg(F.min_by(F.struct("ts", "sun_elevation"), order).alias("b"))
    return best.select("place", "b.ts", "b.sun_elevation")


def most_divergent(pairs: DataFrame, day: str, least_sun: float = LEAST_SUN) -> DataFrame:
    """(pair, ts, divergence): when the shadows of two places point farthest apart, both suns being up.

    ``pairs`` has pair, true_latitude, true_longitude, latitude and longitude. A pair without such an instant has no row.
    """
    own = {"true_azimuth": "sun_azimuth", "true_elevation": "sun_elevation"}
    true = day_scan(pairs.select("pair", F.col("pair").alias("place"), F.col("true_latitude").alias("latitude"), F.col("true_longitude").alias("longitude")), day)
    true = true.select("pair", "ts", *[F.col(v).alias(k) for k, v in own.items()])
    claimed = day_scan(pairs.select("pair", F.col("pair").alias("place"), "latitude", "longitude"), day).select("pair", "ts", "sun_azimuth", "sun_elevation")
    both = true.join(claimed, ["pair", "ts"]).where((F.col("true_elevation") >= least_sun) & (F.col("sun_elevation") >= least_sun))
    apart = both.withColumn("divergence", solar.angle_between(solar.expected_shadow(F.col("true_azimuth")), solar.expected_shadow(F.col("sun_azimuth"))))
    order = F.struct(F.col("divergence").alias("d"), (-F.unix_seconds("ts")).alias("t"))
    return apart.groupBy("pair").agg(F.max_by("ts", order).alias("ts"), F.max("divergence").alias("divergence"))


_VECTOR = ("scenario_id", "kind", "latitude", "longitude", "ts", "observed", "expected_verdict", "least_error")


def _vectors(df: DataFrame, kind: str, observed: Column, expected: Column | str, least_error: float | None = None) -> DataFrame:
    made = df.withColumns({
        "kind": F.lit(kind), "observed": F.pmod(observed, F.lit(360.0)), "expected_verdict": F.lit(expected) if isinstance(expected, str) else expected,
        "least_error": F.lit(least_error).cast("double"),
    })
    return made.select(*_VECTOR)


def genuine(df: DataFrame, jitter: float = JITTER) -> DataFrame:
    """Coherent captures at (scenario_id, latitude, longitude, ts): the shadow is the sun's but for ``jitter`` degrees."""
    sun = solar.with_sun(df)
    return _vectors(sun, "genuine", solar.expected_shadow(F.col("sun_azimuth")) + jitter, "PHYSICS_PASS")


def wrong_clock(df: DataFrame) -> DataFrame:
    """Captures made at ``true_ts`` that claim ``ts``: an honest shadow of another hour."""
    sun = solar.with_sun(df, at="true_ts")
    return _vectors(sun, "fraud", solar.expected_shadow(F.col("sun_azimuth")), "QUARANTINE_SOLAR_MISMATCH", CLOCK_ERROR)


def wrong_place(df: DataFrame, day: str) -> DataFrame:
    """Captures of (true_latitude, true_longitude, true_ts) that claim another place, at the instant that tells most.

    ``df`` has scenario_id, the true and the claimed place. Where no instant has both suns up there is no vector.
    """
    at = most_divergent(df.withColumn("pair", F.col("scenario_id")), day).select(F.col("pair").alias("scenario_id"), "ts")
    there = df.drop("ts").join(at, "scenario_id")
    sun = solar.with_sun(there, latitude="true_latitude", longitude="true_longitude", at="true_ts")
    return _vectors(sun, "fraud", solar.expected_shadow(F.col("sun_azimuth")), "QUARANTINE_SOLAR_MISMATCH", PLACE_ERROR)


def abstain(df: DataFrame) -> DataFrame:
    """Captures that must not be judged, at (scenario_id, latitude, longitude, ts): coherent, with the sun low or down."""
    sun = solar.with_sun(df)
    down = F.when(F.col("sun_elevation") < 0, "QUARANTINE_NIGHTTIME_CAPTURE_ANOMALY").otherwise("REVIEW_LOW_SUN_UNDETERMINED")
    return _vectors(sun, "abstain", solar.expected_shadow(F.col("sun_azimuth")), down)


def judged(vectors: DataFrame, margin: float = MARGIN, tolerance: float = solar.TOLERANCE) -> DataFrame:
    """``vectors`` with the verdict, angular_error, margin and problems: what keeps a vector from being a golden one."""
    rows = solar.with_shadow_verdict(solar.with_sun(vectors)).withColumn("margin", tolerance - F.col("angular_error"))
    problems: Sequence[Column] = (
        F.when(F.col("verdict") != F.col("expected_verdict"), F.concat(F.lit("verdict is "), "verdict")),
        F.when((F.col("kind") == "genuine") & (F.col("margin") < margin), "too near the tolerance"),
        F.when((F.col("kind") == "fraud") & (F.col("angular_error") < F.col("least_error")), "the error is too small"),
    )
    return rows.withColumn("problems", F.array_compact(F.array(*problems)))
