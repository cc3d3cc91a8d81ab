"""Calendar arithmetic and rounding to the rules of monitoring schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_months(start: Column, end: Column) -> Column:
    """Full calendar months from ``start`` to ``end``: one less if the day of the month has not come yet."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - F.when(F.day(end) < F.day(start), 1).otherwise(0)


def lenient_date(text: Column) -> Column:
    """A date from ISO text (a time after it is dropped); null for all else, impossible dates included."""
    day = F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})([T ].*)?$", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")


def solar_noon(day: Column, longitude: Column) -> Column:
    """Local solar noon of a date as a UTC timestamp: 12 h less one hour for every 15 degrees east."""
    micros = F.unix_micros(day.cast("timestamp")) + F.round((12 - longitude / 15) * 3_600_000_000).cast("long")
    return F.timestamp_micros(micros)
