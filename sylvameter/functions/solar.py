"""Sun position by the public NOAA closed form, and shadow verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees a shadow may be off, and the least height of the sun for a verdict.
TOLERANCE = 12.0
LOW_SUN = 10.0


def _turn(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def with_sun(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude", at: str = "ts") -> DataFrame:
    """``df`` with sun_azimuth and sun_elevation in degrees; null where an input is null.

    Steps are columns of their own, so that each is computed once. Azimuth comes from a two-argument arc tangent,
    which needs no case for the hour angle's sign and holds below the horizon as well.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    steps: list[tuple[str, Column]] = [
        ("__t", (micros / 86_400e6 + 2440587.5 - 2451545.0) / 36525.0),
        ("__l", _turn(280.46646 + F.col("__t") * (36000.76983 + F.col("__t") * 0.0003032))),
        ("__m", 357.52911 + F.col("__t") * (35999.05029 - 0.0001537 * F.col("__t"))),
        ("__e", 0.016708634 - F.col("__t") * (0.000042037 + 0.0000001267 * F.col("__t"))),
        ("__w", 125.04 - 1934.136 * F.col("__t")),
        (
            "__c",
            _sin(F.col("__m")) * (1.914602 - F.col("__t") * (0.004817 + 0.000014 * F.col("__t")))
            + _sin(2 * F.col("__m")) * (0.019993 - 0.000101 * F.col("__t"))
            + _sin(3 * F.col("__m")) * 0.000289,
        ),
        ("__a", F.col("__l") + F.col("__c") - 0.00569 - 0.00478 * _sin(F.col("__w"))),
        (
            "__o",
            23.0 + (26.0 + (21.448 - F.col("__t") * (46.815 + F.col("__t") * (0.00059 - F.col("__t") * 0.001813))) / 60.0) / 60.0 + 0.00256 * _cos(F.col("__w")),
        ),
        ("__d", F.degrees(F.asin(_sin(F.col("__o")) * _sin(F.col("__a"))))),
        ("__y", F.pow(F.tan(F.radians(F.col("__o") / 2)), F.lit(2.0))),
        (
            "__q",
            4.0 * F.degrees(
                F.col("__y") * _sin(2 * F.col("__l")) - 2 * F.col("__e") * _sin(F.col("__m"))
                + 4 * F.col("__e") * F.col("__y") * _sin(F.col("__m")) * _cos(2 * F.col("__l"))
                - 0.5 * F.col("__y") * F.col("__y") * _sin(4 * F.col("__l")) - 1.25 * F.col("__e") * F.col("__e") * _sin(2 * F.col("__m"))
            ),
        ),
        ("__h", F.pmod(F.pmod(micros, F.lit(86_400_000_000)) / 60e6 + F.col("__q") + 4 * F.col(longitude), F.lit(1440.0)) / 4 - 180),
        (
            "sun_elevation",
            F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _sin(F.col(latitude)) * _sin(F.col("__d")) + _cos(F.col(latitude)) * _cos(F.col("__d")) * _cos(F.col("__h")))))),
        ),
        (
            "sun_azimuth",
            _turn(F.degrees(F.atan2(_sin(F.col("__h")), _cos(F.col("__h")) * _sin(F.col(latitude)) - F.tan(F.radians("__d")) * _cos(F.col(latitude)))) + 180),
        ),
    ]
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop(*[name for name, _ in steps if name.startswith("__")])


def expected_shadow(azimuth: Column) -> Column:
    return _turn(azimuth + 180)


def angle_between(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings, 0 to 180."""
    d = _turn(a - b)
    return F.least(d, 360 - d)


def with_shadow_verdict(df: DataFrame, observed: str = "observed", tolerance: float = TOLERANCE, low_sun: float = LOW_SUN) -> DataFrame:
    """``df`` (with the sun's place) with expected_shadow, angular_error and verdict. No observation abstains, error 180."""
    error = angle_between(F.col(observed), F.col("expected_shadow"))
    el = F.col("sun_elevation")
    return (
        df.withColumn("expected_shadow", F.when(F.col(observed).isNull(), 0.0).otherwise(expected_shadow(F.col("sun_azimuth"))))
        .withColumn("angular_error", F.when(F.col(observed).isNull(), 180.0).otherwise(error))
        .withColumn(
            "verdict",
            F.when(F.col(observed).isNull(), "REVIEW_INSUFFICIENT_EVIDENCE")
            .when(el < 0, "QUARANTINE_NIGHTTIME_CAPTURE_ANOMALY")
            .when(el < low_sun, "REVIEW_LOW_SUN_UNDETERMINED")
            .when(F.col("angular_error") <= tolerance, "PHYSICS_PASS")
            .otherwise("QUARANTINE_SOLAR_MISMATCH"),
        )
    )


def triage(verdict: Column) -> Column:
    """(decision, confidence) of a verdict."""
    return F.when(verdict == "PHYSICS_PASS", F.struct(F.lit("VERIFIED_PASS").alias("decision"), F.lit(98).alias("confidence"))).when(
        verdict.startswith("QUARANTINE"), F.struct(F.lit("QUARANTINE_FRAUD").alias("decision"), F.lit(96).alias("confidence"))
    ).otherwise(F.struct(F.lit("REVIEW_AMBIGUOUS").alias("decision"), F.lit(62).alias("confidence")))


def time_of_day_report(observed: Column, azimuth: Column, tolerance: float = TOLERANCE) -> Column:
    """(implied_azimuth, implied_half, actual_half, inconsistent): whether a shadow tells another half of the day."""
    implied = _turn(observed + 180)
    half = lambda a: F.when(a < 180, "MORNING").otherwise("AFTERNOON")
    return F.struct(
        implied.alias("implied_azimuth"), half(implied).alias("implied_half"), half(azimuth).alias("actual_half"),
        ((half(implied) != half(azimuth)) & (angle_between(implied, azimuth) > tolerance)).alias("inconsistent"),
    )


def golden_instants(places: DataFrame, day: str, targets: tuple[float, ...]) -> DataFrame:
    """(place, target, ts, sun_elevation): the five-minute instant of a day whose sun is nearest each target height."""
    instants = F.explode(F.sequence(F.to_timestamp(F.lit(day)), F.to_timestamp(F.lit(day)) + F.expr("interval 1435 minutes"), F.expr("interval 5 minutes")))
    sun = with_sun(places.withColumn("ts", instants)).withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    near = F.struct(F.abs(F.col("sun_elevation") - F.col("target")).alias("off"), "ts", "sun_elevation")
    best = sun.groupBy("place", "target").agg(F.min(near).alias("b"))
    return best.select("place", "target", "b.ts", "b.sun_elevation")
