"""Monitoring timelines: captures are placed in the epochs of a schedule, and coverage and gaps follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvameter.functions.temporal import whole_months

#: The standard schedule in months after the start. Its order breaks ties.
SCHEDULE: tuple[tuple[str, int], ...] = (
    ("baseline_month_0", 0), ("progress_month_6", 6), ("progress_month_18", 18), ("certified_year_3", 36),
)
EXPECTED = 3
TOLERANCE = 2


def epoch_of(start: Column, day: Column, phase: Column | None = None, schedule: Sequence[tuple[str, int]] = SCHEDULE, tolerance: int = TOLERANCE) -> Column:
    """The epoch of a capture: its own phase if the schedule has it, else the nearest nominal date within tolerance.

    The schedule has a handful of rows and is unrolled into one expression, so the band join costs no join.
    """
    near = F.array_min(
        F.array(
            *[
                F.struct(F.abs(whole_months(F.add_months(start, months), day)).alias("d"), F.lit(i).alias("i"), F.lit(label).alias("label"))
                for i, (label, months) in enumerate(schedule)
            ]
        )
    )
    by_date = F.when(near["d"] <= tolerance, near["label"])
    if phase is None:
        return by_date
    return F.when(phase.isin([label for label, _ in schedule]), phase).otherwise(by_date)


def assign_epochs(captures: DataFrame, schedule: Sequence[tuple[str, int]] = SCHEDULE, tolerance: int = TOLERANCE) -> DataFrame:
    """``captures`` (project, day, and perhaps phase and start) with start and epoch.

    A project starts at its ``start`` or, where there is none, at its first capture. Undated captures go.
    """
    dated = captures.where(F.col("day").isNotNull())
    first = F.min("day").over(Window.partitionBy("project"))
    start = F.coalesce(F.col("start"), first) if "start" in captures.columns else first
    phase = F.col("phase") if "phase" in captures.columns else None
    return dated.withColumn("start", start).withColumn("epoch", epoch_of(F.col("start"), F.col("day"), phase, schedule, tolerance))


def epoch_report(assigned: DataFrame, schedule: Sequence[tuple[str, int]] = SCHEDULE, expected: int = EXPECTED) -> DataFrame:
    """One row for each project and scheduled epoch, empty ones too: counts, mean measure, dates, status, shortfall.

    ``assigned`` has project, start, epoch, day, decision and measure. One aggregation by project makes conditional
    aggregates for all epochs, so empty epochs need no outer join.
    """
    def one(i: int, label: str, months: int) -> Column:
        own = F.col("epoch") == label
        observed = F.count_if(own)
        return F.struct(
            F.lit(i).alias("ord"), F.lit(label).alias("epoch"), F.add_months(F.min("start"), months).alias("nominal"),
            F.lit(expected).alias("expected"), observed.alias("observed"),
            F.count_if(own & (F.col("decision") == "VERIFIED_PASS")).alias("verified"),
            F.count_if(own & (F.col("decision") == "QUARANTINE_FRAUD")).alias("quarantined"),
            F.avg(F.when(own, F.col("measure"))).alias("mean_measure"),
            F.min(F.when(own, F.col("day"))).alias("first_day"), F.max(F.when(own, F.col("day"))).alias("last_day"),
            F.when(observed >= expected, "FULL").when(observed > 0, "PARTIAL").otherwise("MISSING").alias("status"),
            F.greatest(F.lit(expected) - observed, F.lit(0)).alias("shortfall"),
        )

    epochs = F.array(*[one(i, label, months) for i, (label, months) in enumerate(schedule)])
    return (
        assigned.groupBy("project")
        .agg(F.min("start").alias("start"), F.count("*").alias("total"), epochs.alias("epochs"))
        .select("project", "start", "total", F.explode("epochs").alias("e"))
        .select("project", "start", "total", "e.*")
    )


def timeline_report(epochs: DataFrame) -> DataFrame:
    """One row for each project: totals, coverage (plain and capped by epoch), gaps and the state of the schedule.

    ``coverage_pct`` holds the whole to 100; ``capped_coverage_pct`` counts no epoch beyond what it expects.
    """
    expected = F.sum("expected")
    gaps = F.count_if(F.col("status") != "FULL")
    offset = whole_months(F.col("start"), F.col("nominal"))
    return epochs.groupBy("project").agg(
        F.max("total").alias("total"),
        F.sum("observed").alias("placed"),
        (F.least(F.sum("observed") / expected, F.lit(1.0)) * 100).alias("coverage_pct"),
        (F.sum(F.least("observed", "expected")) / expected * 100).alias("capped_coverage_pct"),
        gaps.alias("gaps"),
        F.coalesce(F.max(F.when(F.col("status") != "FULL", offset)), F.lit(0)).alias("longest_gap_months"),
        F.when(gaps == 0, "ON_SCHEDULE").otherwise("GAPS_DETECTED").alias("state"),
    )


def build_timelines(projects: DataFrame, captures: DataFrame, schedule: Sequence[tuple[str, int]] = SCHEDULE, expected: int = EXPECTED, tolerance: int = TOLERANCE) -> DataFrame:
    """Reports for all ``projects`` (project, and perhaps start): NO_EVIDENCE, without epochs, where no capture is dated."""
    joined = captures.join(projects, "project") if "start" in projects.columns else captures.join(projects.select("project"), "project")
    report = timeline_report(epoch_report(assign_epochs(joined, schedule, tolerance), schedule, expected))
    return projects.select("project").join(report, "project", "left").withColumn("state", F.coalesce("state", F.lit("NO_EVIDENCE"))).fillna(
        {"total": 0, "placed": 0, "coverage_pct": 0.0, "capped_coverage_pct": 0.0, "gaps": 0, "longest_gap_months": 0}
    )


def longest_true_gap(captures: DataFrame) -> DataFrame:
    """(project, longest_gap_days): the longest time between captures that follow each other."""
    last = F.lag("day").over(Window.partitionBy("project").orderBy("day"))
    gaps = captures.withColumn("gap", F.datediff("day", last))
    return gaps.groupBy("project").agg(F.max("gap").cast("long").alias("longest_gap_days"))
