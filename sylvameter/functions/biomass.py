"""Allometry and uncertainty discounts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public pantropical allometry, carbon share, CO2 by carbon, and the precision rule in per cent.
COEFFICIENT, EXPONENT = 0.0673, 0.976
CARBON_SHARE, CO2_BY_CARBON = 0.47, 44.0 / 12.0
ALLOWED_ERROR, MOST_ERROR = 15.0, 22.5
#: One-sided 95 % quantiles of Student's t for 1 to 4 degrees of freedom.
T_SMALL = (6.3138, 2.9200, 2.3534, 2.1318)
Z_95 = 1.6448536269514722


def stem_diameter(canopy_area: Column) -> Column:
    """A stand-in for the diameter at breast height, in cm, from the crown area in square metres."""
    return 2.1 * F.sqrt(canopy_area)


def stem_biomass(density: Column, diameter: Column, height: Column) -> Column:
    """Above-ground biomass of a stem in kg; null unless all inputs are above 0."""
    sound = (density > 0) & (diameter > 0) & (height > 0)
    return F.when(sound, COEFFICIENT * F.pow(density * diameter * diameter * height, F.lit(EXPONENT)))


def co2_tonnes(biomass_kg: Column, stems_per_hectare: Column | None = None, hectares: Column | None = None) -> Column:
    """Tonnes of CO2 of a stem, or of a stand where stems by hectare are given (of one hectare if no area is)."""
    one = biomass_kg * (CARBON_SHARE * CO2_BY_CARBON / 1000.0)
    if stems_per_hectare is None:
        return one
    return one * F.coalesce(stems_per_hectare, F.lit(1)) * (F.lit(1.0) if hectares is None else F.coalesce(hectares, F.lit(1.0)))


def student_t(df: Column) -> Column:
    """The one-sided 95 % quantile: a table below 5 degrees of freedom, Cornish-Fisher from there on."""
    z = Z_95
    n = df.cast("double")
    far = (
        z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n * n)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * n * n * n)
    )
    column = F.when(df < 1, F.lit(None).cast("double"))
    for i, t in enumerate(T_SMALL, 1):
        column = column.when(df == i, t)
    return column.otherwise(far)


def sampling_error_pct(n: Column, mean: Column, sd: Column) -> Column:
    """t * s / (sqrt(n) * mean) * 100; null below two samples or at mean 0."""
    return F.when((n >= 2) & (mean != 0), student_t(n - 1) * sd / (F.sqrt(n) * mean) * 100)


def discount_pct(error: Column) -> Column:
    """Per cent taken off: what the sampling error has above the allowed one."""
    return F.greatest(error - ALLOWED_ERROR, F.lit(0.0))


def discount_status(error: Column) -> Column:
    return F.when(error > MOST_ERROR, "INSUFFICIENT_PRECISION").when(error > ALLOWED_ERROR, "APPLIED").otherwise("NONE")


def net_certified(gross: Column, error: Column) -> Column:
    """Gross less the discount; below zero beyond an error of 115, as the rule has it."""
    return gross * (1 - discount_pct(error) / 100)
