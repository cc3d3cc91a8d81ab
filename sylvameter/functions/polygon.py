"""Parcel polygons whose vertices are pairs of decimal strings (longitude, latitude)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From how many hectares a polygon is asked for, how many decimals, and the sphere of equal area.
NEEDS_POLYGON_HA, DECIMALS, RADIUS_M = 4.0, 6, 6371007.181


def least_decimals(ring: Column) -> Column:
    """The fewest decimals of any coordinate, counted in the text: a double would have lost the zeros."""
    places = F.transform(F.flatten(ring), lambda v: F.length(F.coalesce(F.get(F.split(v, r"\."), F.lit(1)), F.lit(""))))
    return F.array_min(places)


def area_ha(ring: Column) -> Column:
    """Hectares inside a ring by the shoelace rule, on a cylindrical projection of equal area."""
    at = F.transform(
        ring,
        lambda p: F.struct(
            (F.radians(F.get(p, F.lit(0)).try_cast("double")) * RADIUS_M).alias("x"), (F.sin(F.radians(F.get(p, F.lit(1)).try_cast("double"))) * RADIUS_M).alias("y")
        ),
    )
    after = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, 1))
    twice = F.aggregate(F.zip_with(at, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.abs(twice) / 2 / 10_000


def polygon_problem(ring: Column, declared_ha: Column) -> Column:
    """What is wrong with a parcel's polygon, or null: small parcels need none."""
    none = ring.isNull() | (F.size(ring) == 0)
    return (
        F.when(none & (declared_ha > NEEDS_POLYGON_HA), "polygon_missing").when(none, F.lit(None))
        .when((F.size(ring) < 4) | (F.get(ring, F.lit(0)) != F.element_at(ring, -1)), "ring_not_closed")
        .when(least_decimals(ring) < DECIMALS, "too_few_decimals").when(F.coalesce(area_ha(ring), F.lit(0.0)) <= 0, "no_area")
    )
