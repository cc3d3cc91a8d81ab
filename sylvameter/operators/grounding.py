"""Numeric grounding: every figure of a text must come from the facts; and summaries that keep to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.functions.text import figure_value, figures, signed_percent

TOLERANCE = 1e-9
MOST_SENTENCES = 6
TRUSTED_INLIERS = 0.60


def renderings(value: Column) -> Column:
    """The numbers that a fact may be written as: itself and its absolute value, whole and to one and two places."""
    forms = [value, F.round(value, 1), F.round(value, 2)]
    return F.array_distinct(F.array(*[x.cast("double") for x in forms], *[F.abs(x).cast("double") for x in forms]))


def ungrounded(text: Column, allowed: Column) -> Column:
    """The figures of ``text``, as written, that no number of ``allowed`` (an array of doubles) meets."""
    values = F.coalesce(allowed, F.array().cast("array<double>"))
    return F.filter(figures(text), lambda t: ~F.exists(values, lambda a: F.coalesce(F.abs(a - figure_value(t)) < TOLERANCE, F.lit(False))))


def check(df: DataFrame, text: str, facts: list[str]) -> DataFrame:
    """``df`` with n_figures, ungrounded and grounded for a text and its fact columns (null facts allow nothing)."""
    allowed = F.array_compact(F.flatten(F.array(*[renderings(F.col(c)) for c in facts])))
    out = df.withColumn("n_figures", F.size(figures(F.col(text)))).withColumn("ungrounded", ungrounded(F.col(text), allowed))
    return out.withColumn("grounded", F.size("ungrounded") == 0)


def summary(df: DataFrame) -> DataFrame:
    """``df`` of project facts with summary: up to six sentences, each only if its facts are there.

    That registration is above the floor is said only where the mean inlier ratio is.
    """
    def when(condition: Column, *parts: Column | str) -> Column:
        return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))

    n = lambda c, form="%.1f": F.format_string(form, F.col(c).cast("double"))
    sentences = F.array(
        when(F.col("total") > 0, F.col("project_name"), " has ", F.col("total"), " assets, of which ", F.col("verified"), " are verified."),
        when(F.col("quarantined") > 0, F.col("quarantined"), " assets are in quarantine and ", F.col("review"), " await review."),
        when(F.col("canopy_delta_pct").isNotNull(), "Canopy changed by ", signed_percent(F.col("canopy_delta_pct").cast("double")), "."),
        when(F.col("mean_inlier_ratio") >= TRUSTED_INLIERS, "Registration is above the floor with a mean inlier ratio of ", n("mean_inlier_ratio", "%.2f"), "."),
        when(F.col("net_certified_tco2e").isNotNull(), "Net certified removals are ", n("net_certified_tco2e"), " tCO2e."),
        when(F.col("sampling_error_pct").isNotNull(), "The sampling error is ", n("sampling_error_pct"), "%."),
        when(F.col("area_ha").isNotNull(), "The area is ", n("area_ha"), " ha."),
    )
    return df.withColumn("summary", F.array_join(F.slice(F.array_compact(sentences), 1, MOST_SENTENCES), " "))


def enhanced(df: DataFrame, candidate: str, facts: list[str], fallback: str = "summary") -> DataFrame:
    """``df`` with text and source: a rewritten summary if every figure of it is grounded, else the plain one."""
    judged = check(df, candidate, facts)
    good = F.col(candidate).isNotNull() & (F.trim(candidate) != "") & F.col("grounded")
    out = judged.withColumn("text", F.when(good, F.col(candidate)).otherwise(F.col(fallback)))
    return out.withColumn("text_source", F.when(good, "REWRITTEN").otherwise("TEMPLATE"))
