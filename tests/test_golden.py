"""Golden vectors: every builder gives what its kind asks for, and the judge finds what does not."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sylvameter.functions import solar
from sylvameter.operators import golden
from sylvameter.sources import corpus

DAY = "2026-03-20"


@pytest.fixture(scope="module")
def places(spark):
    rows = [(p[0], p[4], p[5]) for p in corpus.PROJECTS] + [("north", 66.0, 20.0), ("pole", 89.0, 0.0)]
    return spark.createDataFrame(rows, "place string, latitude double, longitude double")


def test_noon_and_heights(spark, places):
    scan = golden.day_scan(places, DAY).collect()
    assert len(scan) == 6 * 288
    noon = {r.place: r for r in golden.noon(places, DAY).collect()}
    low = {late: {r.place: r for r in golden.at_height(places, DAY, 5.0, late).collect()} for late in (False, True)}
    for name in noon:
        own = sorted(((r.ts, r.sun_elevation) for r in scan if r.place == name), key=lambda x: x[0])
        assert noon[name].ts == max(own, key=lambda x: x[1])[0]
        up = [x for x in own if x[1] >= 5]
        assert bool(up) == (name in low[False])
        if up:
            assert low[False][name].ts == min(up, key=lambda x: x[1] - 5)[0]
            late = [x for x in up if x[0].hour * 60 + x[0].minute > 720] or up
            assert low[True][name].ts == min(late, key=lambda x: x[1] - 5)[0]
    assert "pole" not in low[False] and noon["KEN-008"].sun_elevation > 80


def test_time_zone_of_the_session_does_not_matter(spark, places):
    before = spark.conf.get("spark.sql.session.timeZone")
    want = {r.place: r.t for r in golden.noon(places, DAY).select("place", F.unix_seconds("ts").alias("t")).collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {r.place: r.t for r in golden.noon(places, DAY).select("place", F.unix_seconds("ts").alias("t")).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_vectors_are_golden(spark, places):
    four = places.where("place not in ('north', 'pole')")
    at = golden.noon(four, DAY).join(four, "place").withColumnRenamed("place", "scenario_id").drop("sun_elevation")
    hours = lambda n: F.timestamp_seconds(F.unix_seconds("ts") + n * 3600)
    dawn = golden.at_height(four, DAY).join(four, "place").withColumnRenamed("place", "scenario_id").drop("sun_elevation")
    morning = at.withColumn("true_ts", hours(-3)).withColumn("ts", hours(3))
    swaps = at.where("scenario_id = 'KEN-008'").select(
        "scenario_id", F.col("latitude").alias("true_latitude"), F.col("longitude").alias("true_longitude"), hours(-1).alias("true_ts"), F.lit(48.0).alias("latitude"), F.lit(30.0).alias("longitude")
    )
    kinds = {
        "genuine": (golden.genuine(at), "PHYSICS_PASS", 4), "clock": (golden.wrong_clock(morning), "QUARANTINE_SOLAR_MISMATCH", 4), "place": (golden.wrong_place(swaps, DAY), "QUARANTINE_SOLAR_MISMATCH", 1),
        "dawn": (golden.abstain(dawn), "REVIEW_LOW_SUN_UNDETERMINED", 4), "night": (golden.abstain(at.withColumn("ts", hours(12))), "QUARANTINE_NIGHTTIME_CAPTURE_ANOMALY", 4),
    }
    for name, (vectors, verdict, n) in kinds.items():
        rows = golden.judged(vectors).collect()
        assert len(rows) == n and {r.verdict for r in rows} == {verdict} and all(r.problems == [] for r in rows), (name, rows)


def test_judge_finds_what_is_not_golden(spark):
    noon = dt.datetime(2026, 3, 20, 9, 30)
    rows = [("a", -3.6, 39.85, noon)]
    df = spark.createDataFrame(rows, "scenario_id string, latitude double, longitude double, ts timestamp")
    near = golden.judged(golden.genuine(df, jitter=9.0)).first()
    assert near.verdict == "PHYSICS_PASS" and near.problems == ["too near the tolerance"]
    off = golden.judged(golden.genuine(df, jitter=30.0)).first()
    assert off.problems == ["verdict is QUARANTINE_SOLAR_MISMATCH", "too near the tolerance"]
    same = golden.judged(golden.wrong_clock(df.withColumn("true_ts", F.col("ts")))).first()
    assert same.problems == ["verdict is PHYSICS_PASS", "the error is too small"]


def test_divergence_is_the_largest_of_the_day(spark):
    rows = [("x", -1.3, 36.8, 40.0, 32.8), ("none", 10.0, 0.0, 10.0, 180.0), ("same", 10.0, 5.0, 10.0, 5.0)]
    pairs = spark.createDataFrame(rows, "pair string, true_latitude double, true_longitude double, latitude double, longitude double")
    got = {r.pair: r for r in golden.most_divergent(pairs, DAY).collect()}
    assert set(got) == {"x", "same"} and got["same"].divergence == 0
    side = [{r.ts: r for r in golden.day_scan(spark.createDataFrame([("p", *x)], "place string, latitude double, longitude double"), DAY).collect()} for x in ((-1.3, 36.8), (40.0, 32.8))]
    apart = [(min(d, 360 - d), t) for t in side[0] for d in [abs(side[0][t].sun_azimuth - side[1][t].sun_azimuth)] if min(s[t].sun_elevation for s in side) >= 10]
    best = max(apart, key=lambda x: (x[0], -x[1].timestamp()))
    assert got["x"].divergence == pytest.approx(best[0]) and got["x"].ts == best[1] and best[0] > solar.TOLERANCE
