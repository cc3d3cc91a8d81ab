"""The bulk run: every asset through every check, with faults put in, and the tallies of the verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvameter.functions import solar
from sylvameter.functions.temporal import lenient_date, solar_noon
from sylvameter.operators import measure


def with_faults(assets: DataFrame, number: str, fault_every: int = 10, low_sun_every: int = 10) -> DataFrame:
    """``assets`` with instant and observed: shadows at local noon, a stride of them turned, another at low sun."""
    noon = solar_noon(lenient_date(F.col("capture_timestamp")), F.col("longitude"))
    low = F.pmod(F.col(number), F.lit(low_sun_every)) == low_sun_every // 2
    fault = F.pmod(F.col(number), F.lit(fault_every)) == 0
    instant = F.when(low, F.timestamp_micros(F.unix_micros(noon) - F.lit(5 * 3_600_000_000 + 2_100_000_000))).otherwise(noon)
    sun = solar.with_sun(assets.withColumn("instant", instant), at="instant")
    turn = F.when(fault, 90.0).otherwise(0.0)
    return sun.withColumn("observed", F.pmod(solar.expected_shadow(F.col("sun_azimuth")) + turn, F.lit(360.0)))


def run(assets: DataFrame, number: str) -> DataFrame:
    """Verdicts of all assets: one projection, no shuffle."""
    judged = solar.with_shadow_verdict(with_faults(assets, number))
    decision: Column = solar.triage(F.col("verdict"))
    return judged.withColumn("decision", decision["decision"]).withColumn("confidence", decision["confidence"])


def bulk(assets: DataFrame, images: DataFrame, number: str) -> DataFrame:
    """The whole run: verdicts of ``assets`` joined with every image stage of ``images`` (see ``measure.measure_assets``).

    ``assets`` has asset_id, capture_timestamp, latitude, longitude and ``number``. Image bytes are measured where they are
    read; what is joined are the figures. An asset without an image keeps its verdict and has nulls. The figures are as
    many as the images and their size is not known before, so they are never broadcast.
    """
    measured = measure.measure_assets(images).hint("merge")
    joined = run(assets, number).join(measured, "asset_id", "left")
    return joined.withColumn("forgery", measure.forgery_action(F.col("noise"), F.col("fft_peak"), F.col("moire"))["action"]).withColumn(
        "forgery", F.when(F.col("status") == "INGESTED", F.col("forgery"))
    )


def report(done: DataFrame, provenance: str = "c2pa_provenance") -> DataFrame:
    """(verdict, n, contradictions, rejected, natural, trusted): the counts of a bulk run."""
    contradiction = (F.col("decision") == "QUARANTINE_FRAUD") & (F.col(provenance) == "C2PA_VERIFIED")
    return done.groupBy("verdict").agg(
        F.count("*").alias("n"), F.count_if(contradiction).alias("contradictions"), F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.count_if(F.col("forgery") == "NATURAL").alias("natural"), F.count_if(F.col("trust") == "trusted").alias("trusted"),
    )


#: The rules by which reports of percentiles find their place (from 1) among n values.
PLACES = {
    "nearest": lambda q, n: F.greatest(F.bround(q * n, 0), F.lit(1.0)),
    "above": lambda q, n: F.least(F.floor(q * n) + 1, n),
    "whole": lambda q, n: F.greatest(F.ceil(F.floor(F.round(q * 100, 6) * n) / 100), F.lit(1)),
}


def percentiles(df: DataFrame, metrics: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95, 0.99), rule: str = "nearest", *groups: str) -> DataFrame:
    """(groups, metric, n, p50 ..., least, most): exact percentiles of many metrics in one aggregation.

    Values are counted by metric before they are ranked, so equal values meet once; nulls take no part, and a metric
    without a value has no row. ``rule`` is one of PLACES.
    """
    long = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    counts = df.select(*groups, long).where("value is not null").groupBy(*groups, "metric", "value").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*groups, "metric")
    ranked = counts.withColumn("upto", F.sum("n").over(own.orderBy("value"))).withColumn("all", F.sum("n").over(own))
    places = [F.min(F.when(F.col("upto") >= PLACES[rule](F.lit(q), F.col("all")), F.col("value"))).alias(f"p{round(q * 100)}") for q in quantiles]
    return ranked.groupBy(*groups, "metric").agg(F.sum("n").alias("n"), *places, F.min("value").alias("least"), F.max("value").alias("most"))


def tallies(judged: DataFrame, provenance: str = "c2pa_provenance") -> DataFrame:
    """(verdict, n, contradictions): contradictions are quarantined assets whose provenance says they are sound."""
    contradiction = (F.col("decision") == "QUARANTINE_FRAUD") & (F.col(provenance) == "C2PA_VERIFIED")
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(contradiction).alias("contradictions"))
