import datetime as dt

from pyspark.sql import functions as F

from sylvameter.functions.temporal import lenient_date, whole_months
from sylvameter.operators import catalogue, timeline
from sylvameter.sources import corpus


def test_corpus_is_the_same_each_time_and_has_its_shape(spark):
    rows = corpus.generate()
    assert len(rows) == 520 and rows == corpus.generate()
    assert all(r["canopy_delta_pct"] is None for r in rows if r["milestone_phase"] == "baseline_month_0")
    many = corpus.generate(400)
    share = sum(r["jev_triage_decision"] == "VERIFIED_PASS" for r in many) / len(many)
    assert abs(share - 0.72) < 0.05
    one = corpus.summary(corpus.assets(spark)).first()
    assert (one.total, one.projects, one.epochs) == (520, 4, 4)


def test_facets_lift_their_own_filter(spark):
    df = corpus.assets(spark)
    chosen = {"jev_triage_decision": "VERIFIED_PASS", "milestone_phase": "baseline_month_0", "c2pa_provenance": None}
    got = {(r.axis, r.value): r.n for r in catalogue.facet_counts(df, chosen).collect()}
    rows = corpus.generate()
    for axis in chosen:
        others = [r for r in rows if all(v is None or r[k] == v for k, v in chosen.items() if k != axis)]
        for value in {r[axis] for r in others}:
            assert got[axis, value] == sum(r[axis] == value for r in others)
    ordered = catalogue.facets_ordered(catalogue.facet_counts(df, chosen)).collect()
    assert all([-v.n for v in r["values"]] == sorted(-v.n for v in r["values"]) for r in ordered)


def test_filters_and_pages(spark):
    df = corpus.assets(spark)
    assert catalogue.filter_catalogue(df, {"esg_project_id": ""}, tag=None, text="").count() == 520
    hits = catalogue.filter_catalogue(df, text="MANGROVE")
    assert hits.count() == sum("mangrove" in r["public_id"] or "mangrove" in r["tags"] for r in corpus.generate())
    order = [F.desc("capture_timestamp"), F.asc("asset_id")]
    pages = [r.asset_id for offset in (0, 200, 400) for r in catalogue.page(df, order, 200, offset).collect()]
    assert len(pages) == len(set(pages)) == 520
    assert catalogue.page(df, order, 5000).count() == 200
    total = catalogue.page_totals(df, 60, 500).first()
    assert (total.total, total.returned, total.has_more) == (520, 20, False)


def test_dates(spark):
    row = spark.range(1).select(
        *[lenient_date(F.lit(x)).alias(f"d{i}") for i, x in enumerate(("2025-03-05", "2025-3-5", "2025-99-99", "2025-03-05T10:00:00Z", None))],
        F.add_months(F.lit("2025-01-31").cast("date"), 1).alias("a"),
        *[whole_months(F.lit("2025-03-15").cast("date"), F.lit(x).cast("date")).alias(f"m{i}") for i, x in enumerate(("2025-09-14", "2025-09-15", "2024-09-15"))],
    ).first()
    assert (row.d0, row.d1, row.d2, row.d3, row.d4) == (dt.date(2025, 3, 5), None, None, dt.date(2025, 3, 5), None)
    assert row.a == dt.date(2025, 2, 28) and (row.m0, row.m1, row.m2) == (5, 6, -6)


def _captures(spark, rows):
    return spark.createDataFrame([(p, d, ph, dec, m) for p, d, ph, dec, m in rows], "project string, day date, phase string, decision string, measure double")


def test_timeline_scenarios(spark):
    start = dt.date(2024, 1, 10)
    day = [dt.date(2024, 1, 12), dt.date(2024, 7, 12), dt.date(2025, 7, 12), dt.date(2027, 1, 12)]
    rows = [("healthy", d, None, "VERIFIED_PASS", 1.0) for d in day for _ in range(3)]
    rows += [("missing", d, None, "VERIFIED_PASS", 1.0) for d in day[:3] for _ in range(3)]
    rows += [("burst", day[0], None, "VERIFIED_PASS", None) for _ in range(12)]
    rows += [("stray", d, None, "VERIFIED_PASS", 1.0) for d in day for _ in range(3)] + [("stray", dt.date(2030, 1, 1), None, "VERIFIED_PASS", 1.0)]
    rows += [("partial", day[0], None, "VERIFIED_PASS", 1.0)] * 3 + [("partial", day[1], None, "QUARANTINE_FRAUD", 1.0)]
    rows += [("undated", None, None, "VERIFIED_PASS", 1.0)]
    projects = spark.createDataFrame([(p, start) for p in ("healthy", "missing", "burst", "stray", "partial", "undated", "empty")], "project string, start date")
    got = {r.project: r for r in timeline.build_timelines(projects, _captures(spark, rows)).collect()}
    assert got["healthy"].state == "ON_SCHEDULE" and got["healthy"].coverage_pct == 100
    assert (got["missing"].gaps, got["missing"].coverage_pct, got["missing"].longest_gap_months) == (1, 75, 36)
    assert (got["burst"].gaps, got["burst"].coverage_pct, got["burst"].capped_coverage_pct) == (3, 100, 25)
    assert (got["stray"].total, got["stray"].placed) == (13, 12)
    assert got["undated"].state == got["empty"].state == "NO_EVIDENCE"
    epochs = timeline.epoch_report(timeline.assign_epochs(_captures(spark, rows).join(projects, "project")))
    month6 = epochs.where("project = 'partial' and epoch = 'progress_month_6'").first()
    assert (month6.status, month6.shortfall, month6.quarantined) == ("PARTIAL", 2, 1)
    five = {r.project: r for r in timeline.build_timelines(projects, _captures(spark, rows), expected=5).collect()}
    assert five["healthy"].coverage_pct == 60
