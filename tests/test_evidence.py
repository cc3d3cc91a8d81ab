import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvameter.functions import biomass, diagnostics, geometry, imaging, polygon, solar
from sylvameter.operators import batch, dedup, intervals, links, measure, tagging
from sylvameter.sources import corpus

#: Published positions of the sun: id, latitude, longitude, UTC, observed shadow, azimuth, elevation, verdict.
SUN = [
    ("GEN_01", -1.2921, 36.8219, "2026-09-22T08:15:30", 267.06, 85.06, 72.43, "PHYSICS_PASS"),
    ("GEN_02", -1.2921, 36.8219, "2026-09-22T09:32:00", 134.11, 313.11, 87.76, "PHYSICS_PASS"),
    ("GEN_03", 39.9207, 32.8541, "2026-06-21T09:48:00", 359.58, 178.08, 73.51, "PHYSICS_PASS"),
    ("GEN_04", 52.52, 13.405, "2026-12-21T11:05:00", 1.64, 180.14, 14.04, "PHYSICS_PASS"),
    ("GEN_05", -2.8541, 38.4521, "2026-09-22T11:30:00", 96.8, 274.8, 57.1, "PHYSICS_PASS"),
    ("FRAUD_01", -2.8541, 38.4521, "2026-09-22T11:30:00", 268.07, 274.8, 57.1, "QUARANTINE_SOLAR_MISMATCH"),
    ("FRAUD_02", -2.8541, 38.4521, "2026-09-22T05:15:00", 94.8, 88.07, 28.94, "QUARANTINE_SOLAR_MISMATCH"),
    ("FRAUD_03", 39.9207, 32.8541, "2026-09-22T09:25:00", 265.06, 173.62, 50.14, "QUARANTINE_SOLAR_MISMATCH"),
    ("ABSTAIN_01", -1.2921, 36.8219, "2026-09-22T15:05:00", 90.26, 270.26, 5.09, "REVIEW_LOW_SUN_UNDETERMINED"),
    ("ABSTAIN_02", -1.2921, 36.8219, "2026-09-22T22:00:00", 278.19, 98.19, -81.23, "QUARANTINE_NIGHTTIME_CAPTURE_ANOMALY"),
]


def test_sun_and_shadow(spark):
    rows = [(i, la, lo, dt.datetime.fromisoformat(t).replace(tzinfo=dt.timezone.utc), o) for i, la, lo, t, o, *_ in SUN] + [("NONE", 0.0, 0.0, dt.datetime(2026, 1, 1, 12), None)]
    df = spark.createDataFrame(rows, "id string, latitude double, longitude double, ts timestamp, observed double")
    got = {r.id: r for r in solar.with_shadow_verdict(solar.with_sun(df)).collect()}
    for i, *_, az, el, verdict in SUN:
        assert abs((got[i].sun_azimuth - az + 180) % 360 - 180) < 0.5 and abs(got[i].sun_elevation - el) < 0.5 and got[i].verdict == verdict
    assert (got["NONE"].verdict, got["NONE"].angular_error) == ("REVIEW_INSUFFICIENT_EVIDENCE", 180.0)


def test_golden_instants_and_bulk_run(spark):
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 50.0, 10.0)], "place string, latitude double, longitude double")
    got = solar.golden_instants(places, "2026-09-22", (45.0,)).collect()
    assert len(got) == 2 and all(abs(r.sun_elevation - (45 if r.place == "a" else 40)) < 2 for r in got)
    rows = corpus.assets(spark).withColumn("number", F.substring("asset_id", -4, 4).cast("int"))
    tally = {r.verdict: r.n for r in batch.tallies(batch.run(rows, "number")).collect()}
    assert sum(tally.values()) == 520 and tally["PHYSICS_PASS"] > 300 and tally["QUARANTINE_SOLAR_MISMATCH"] == 52


def test_biomass(spark):
    kg = biomass.stem_biomass(F.lit(0.45), F.lit(6.8), F.lit(3.9))
    errors = [18.0, 25.0, 40.0, 15.0, 22.5]
    row = spark.range(1).select(
        kg.alias("kg"), biomass.co2_tonnes(kg, F.lit(1100), F.lit(1.0)).alias("t"), biomass.stem_biomass(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("none"),
        F.array(*[biomass.discount_pct(F.lit(e)) for e in errors]).alias("d"), F.array(*[biomass.discount_status(F.lit(e)) for e in errors]).alias("s"),
        F.array(*[biomass.student_t(F.lit(n)) for n in (1, 4, 10)]).alias("tq"),
    ).first()
    assert row.kg == pytest.approx(4.9146, abs=1e-3) and row.t == pytest.approx(9.3164, abs=1e-3) and row.none is None
    assert row.d == [3, 10, 25, 0, 7.5] and row.s == ["APPLIED", "INSUFFICIENT_PRECISION", "INSUFFICIENT_PRECISION", "NONE", "APPLIED"]
    assert row.tq == pytest.approx([6.3138, 2.1318, 1.8125], abs=1e-3)


def test_hamming_nearest_and_bands(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, int(k), replace=False)) for b in base for k in (0, 3, 9)]
    rows = [(str(i), v >> 32, v & 0xFFFFFFFF, str(i % 2), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "asset_id string, hi long, lo long, project_id string, seq long")

    def check(found, **settings):
        rows = found.collect()
        assert len(rows) == len(values)
        for r in rows:
            near = [((values[r.seq] ^ values[j]).bit_count(), j) for j in range(r.seq if settings.get("earlier_only") else len(values)) if not settings.get("same_project") or (r.seq - j) % 2 == 0]
            best = min((x for x in near if x[0] < 64 and x[0] <= settings.get("most_distance", 64)), default=None)
            assert (r.distance, r.match_id) == ((best[0], str(best[1])) if best else (None, None)), settings

    for settings in ({"earlier_only": True}, {"earlier_only": True, "same_project": True}, {"earlier_only": True, "most_distance": 12}, {}):
        check(dedup.nearest(df, df, **settings), **settings)
    plans = [dedup.nearest(df, df, earlier_only=True, most_distance=m)._jdf.queryExecution().toString() for m in (None, 12)]
    assert not any(x in p for p in plans for x in ("NestedLoop", "Cartesian"))
    pairs = {(r.a, r.b) for r in dedup.banded_pairs(df, 8).collect()}
    assert pairs == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (values[a[4]] ^ values[b[4]]).bit_count() <= 8}
    verdicts = spark.createDataFrame([(8, "a", "b"), (9, "a", "b"), (13, "a", "b"), (0, "a", "a"), (None, "a", None)], "d int, a string, m string")
    assert [r[0] for r in verdicts.select(dedup.verdict(F.col("d"), F.col("a"), F.col("m"))).collect()] == ["QUARANTINE_DUPLICATE", "REVIEW_SIMILAR", "UNIQUE", "RESUBMISSION", "UNIQUE"]


def test_hash_search_broadcasts_no_exploded_bands(spark, monkeypatch):
    """Probes once for each band and bit are many times their table, which looks small enough to be broadcast."""
    rng = np.random.default_rng(7)
    base = [int(v) for v in rng.integers(0, 1 << 63, 30, dtype=np.uint64)]
    values = [v ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for v in base for k in (0, 4, 8, 10)]
    df = spark.createDataFrame([(i, v >> 32, v & 0xFFFFFFFF, None, i) for i, v in enumerate(values)], "asset_id long, hi long, lo long, project_id string, seq long")
    plans, write = [], dedup.materialise
    monkeypatch.setattr(dedup, "materialise", lambda t: plans.append(t._jdf.queryExecution().executedPlan().toString()) or write(t))
    for most in (None, 4, 8, 9, 12):
        want = {i: min(((v ^ values[j]).bit_count(), j) for j in range(i)) for i, v in enumerate(values) if i}
        got = {r.asset_id: (r.distance, r.match_id) for r in dedup.nearest(df, df, earlier_only=True, most_distance=most).collect()}
        assert got == {0: (None, None)} | {i: x if x[0] <= (64 if most is None else most) else (None, None) for i, x in want.items()}
    by_band = [p for p in plans if "p_band" in p]
    assert len(by_band) == 7 and all("SortMergeJoin [p_band" in p for p in by_band)


def test_hash_corpus_that_grows(spark, tmp_path):
    """Appended in batches, one of them twice, with nulls and many copies of a hash: as one search over all rows."""
    rng = np.random.default_rng(6)
    values = [int(v) for v in rng.integers(0, 1 << 62, 12)]
    rows = [(i, (v ^ m) >> 32, (v ^ m) & 0xFFFFFFFF, "p" if i % 3 else None, i) for i, (v, m) in enumerate((v, m) for m in (0, 0, 1 << 40, 3 | 7 << 29) for v in values)]
    rows += [(100, None, 5, "p", 100), (101, 5, None, None, 101)]
    df = spark.createDataFrame(rows, "asset_id long, hi long, lo long, project_id string, seq long")
    kept = dedup.HashCorpus(spark, str(tmp_path / "hashes"))
    kept.append(df.where("seq < 20"), "a")
    kept.append(df.where("seq >= 20 and seq < 90"), "b")
    kept.append(df.where("seq >= 20"), "b")
    assert kept.rows().count() == 48
    for settings in ({"earlier_only": True}, {"most_distance": 4}, {"same_project": True, "earlier_only": True}):
        got, want = ({r.asset_id: (r.match_id, r.distance) for r in f(**settings).collect()} for f in (lambda **k: kept.nearest(df, **k), lambda **k: dedup.nearest(df, df, **k)))
        assert got == want and got[100] == got[101] == (None, None)
    # one that comes back is matched with what it resembles, and once it is in the corpus with itself
    probe = spark.createDataFrame([(500, (values[3] ^ 5) >> 32, (values[3] ^ 5) & 0xFFFFFFFF, "q", 500)], df.schema)
    assert [(r.match_id, r.distance) for r in kept.nearest(probe).collect()] == [(3, 2)]
    kept.append(probe, "c")
    assert [(r.match_id, r.distance) for r in kept.nearest(probe).collect()] == [(500, 0)]
    assert kept.nearest(df.limit(0)).count() == 0


def test_captions(spark):
    rows = [("v", 0, "forest", 0.0, 10.0, 0.9), ("v", 1, "canopy", 2.0, 6.0, 0.7), ("v", 2, "blur", 3.0, 3.5, 0.2), ("v", 3, "forest", 2.0, 6.0, 0.65), ("w", 0, "late", 0.0, 90.0, 0.8)]
    seg = spark.createDataFrame(rows, "video_id string, seq int, tag string, start double, end double, confidence double")
    cues = intervals.cues(seg)
    got = [(r.video_id, r.cue, r.start, r.end, r.lines) for r in cues.orderBy("video_id", "cue").collect()]
    assert got == [("v", 1, 0, 2, ["forest"]), ("v", 2, 2, 3, ["forest", "canopy"]), ("v", 3, 3.5, 6, ["forest", "canopy"]), ("v", 4, 6, 10, ["forest"]), ("w", 1, 0, 60, ["late"])]
    assert [r.cue for r in intervals.cues(seg, most_cues=2).where("video_id = 'v'").orderBy("cue").collect()] == [1, 2]
    docs = intervals.caption_documents(cues).join(cues.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    assert all(r[0] == [] for r in docs.select(intervals.caption_problems(F.col("vtt"), F.col("n"))).collect())
    bad = "WEBVTT\n\n1\n00:00:05.000 --> 00:00:04.000\na\n\n2\n00:00:03.000 --> oops\nb\n"
    assert spark.range(1).select(intervals.caption_problems(F.lit(bad), 3)).first()[0] == ["bad_time", "backward_cue", "overlap", "cue_count"]
    pins = intervals.hotspots(seg, spark.createDataFrame([("canopy", "Canopy!", "d")], "tag string, title string, description string")).where("video_id = 'v'").orderBy("number").collect()
    assert [(p.hotspot_id, p.title) for p in pins] == [("pin-1-forest", "Forest"), ("pin-2-canopy", "Canopy!"), ("pin-3-forest", "Forest")]
    assert [r.tag for r in intervals.active_at(seg, 10.4, 0.5).where("video_id = 'v'").collect()] == ["forest"]
    payload = '{"info":{"categorization":{"google_video_tagging":{"data":[{"tag":"a","start":5,"end":2,"confidence":0.7},{"tag":null,"start":1,"end":2},{"tag":"b","start_time_offset":1,"end_time_offset":3}]}}}}'
    parsed = intervals.segments_from_json(spark.createDataFrame([("v", payload), ("x", "junk")], "video_id string, payload string")).collect()
    assert [(r.tag, r.start, r.end, r.confidence) for r in parsed] == [("b", 1, 3, 1), ("a", 2, 5, 0.7)]


def test_tags(spark):
    df = spark.createDataFrame([(True, 0.5, 0.3, 0.0, 0.0, 0.0, 0.1, 0.2, 0.0, 100.0, 70.0, 1000, 500, "baseline_month_0", "mangrove_restoration", "image", 12)],
        "detectable boolean, cover double, green double, yellow double, brown double, magenta double, water double, sky double, edges double, luma_mean double, luma_std double, width int, height int, milestone_phase string, sustainability_domain string, media_type string, hour int")
    row = tagging.enrich(df.withColumn("x", F.create_map(F.lit("River"), F.lit(0.1), F.lit("cloud"), F.lit(0.95), F.lit("zebra"), F.lit(1.0))), "x").first()
    names = [t.tag for t in row.tags]
    assert names.count("harsh_sun") == 2 and names.count("mangrove") == 2 and "overcast" in names and "zebra" not in names
    assert [t.confidence for t in row.tags] == sorted((t.confidence for t in row.tags), reverse=True)
    assert [(c.tag, c.external_confidence) for c in row.conflicts] == [("water", 0.1)]
    assert next(t.confidence for t in row.tags if t.tag == "overcast") == 0.9
    kept = df.select(F.size(tagging.grounded(tagging.pixel_tags())) == F.size(tagging.pixel_tags())).first()[0]
    assert kept


def test_images(spark):
    scenes = list(corpus.scenes(2, 96, 128))
    rows = [*scenes, ("bad", 5, 5, b"123"), ("null", None, None, None)]
    got = {r.image_id: r for r in measure.measure_images(spark.createDataFrame(rows, "image_id string, height int, width int, data binary")).collect()}
    assert got["bad"].status == got["null"].status == "REJECTED" and got["scene-0000"].status == "INGESTED" and len(got["scene-0000"].phash) == 16
    image = np.frombuffer(scenes[0][3], np.uint8).reshape(96, 128, 3)
    smooth = np.full((96, 128, 3), 90, np.uint8)
    assert imaging.canopy_mask(smooth) is None and imaging.forgery_signals(smooth)["noise"] < imaging.NOISE_FLOOR
    dim = (image * 0.6).astype(np.uint8)
    near = bin(int(imaging.perceptual_hash(image), 16) ^ int(imaging.perceptual_hash(dim), 16)).count("1")
    assert near <= 8
    assert np.abs(imaging.green_leaf_index(image) - imaging.green_leaf_index(dim)).mean() < 0.05
    grown = image.copy()
    grown[72:, :64] = image[24:48, :64]
    pairs = spark.createDataFrame([("p", 96, 128, image.tobytes(), dim.tobytes()), ("q", 96, 128, image.tobytes(), grown.tobytes()), ("r", 96, 128, image.tobytes(), b"x")], "pair_id string, height int, width int, before binary, after binary")
    out = {r.pair_id: r for r in measure.measure_pairs(pairs).collect()}
    assert out["p"].gain_status == "OK" and abs(out["p"].change_pct) < 10 and out["q"].change_pct > 30 and out["r"].status == "SHAPE_MISMATCH"
    assert imaging.radiometric_gains(image, (image * 0.2).astype(np.uint8))["status"] == "REFUSED"
    assert abs(diagnostics.match_histogram(dim, image).mean() - image.mean()) < 3
    mask = np.zeros((40, 40), bool)
    mask[2:10, 2:10] = mask[20:24, 20:24] = True
    assert imaging.largest_region(mask) == 64


def test_registration(spark):
    rng = np.random.default_rng(3)
    turn = np.radians(8)
    src = rng.uniform(0, 600, (150, 2))
    dst = src @ np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]).T + 15 + rng.normal(0, 0.2, src.shape)
    dst[:20] += rng.uniform(-90, 90, (20, 2))
    rows = [("good", *map(float, (*a, *b)), 0.5) for a, b in zip(src, dst, strict=True)] + [("few", 1.0, 1.0, 2.0, 2.0, 0.1)] * 5 + [("weak", float(i), float(i * i), 1.0, 2.0, 0.9) for i in range(30)]
    got = {r.pair_id: r for r in measure.register_pairs(spark.createDataFrame(rows, "pair_id string, sx double, sy double, dx double, dy double, ratio double")).collect()}
    assert got["good"].status == "OK" and got["good"].trust == "trusted" and got["good"].rmse < 1
    assert got["good"].homography[0] == pytest.approx(np.cos(turn), abs=0.01) and got["good"].homography[2] == pytest.approx(15, abs=1)
    assert got["few"].status == "TOO_FEW_POINTS" and got["weak"].status == "TOO_FEW_MATCHES" and got["few"].rmse is None
    bent = src + 12 * np.sin(src[:, ::-1] / 60)
    fit = geometry.thin_plate(src, bent)
    assert np.abs(fit(src) - bent).max() < 0.1 < geometry.affine_residual(src, bent)
    assert geometry.displacement_field(fit, 600, 600).shape == (24, 32, 2) and geometry.detection_scale(3840, 2160) == 2.0


def test_links(spark):
    out = links.campaign(corpus.assets(spark), corpus.projects(spark), "https://m.example.org/x").collect()
    assert len(out) == 4 and all(r.split_url.startswith("https://m.example.org/x/image/upload/c_fill") and " " not in r.split_url for r in out)
    figures = spark.createDataFrame([("P/1", "a/b", 1.0, 2.0, "r"), (" ", "a/b", 1.0, 2.0, "r"), ("P", "a/b", None, 2.0, "r")], "project_id string, public_id string, tonnes double, error double, root string")
    got = links.report(figures, "https://m", "https://app/").collect()
    assert got[0].record_url == "https://app/api/v1/assets/P%2F1/provenance" and [r.problem for r in got] == [None, "blank_project", "missing_figure"] and got[1].pdf_url is None
    log = spark.createDataFrame([("a/b",), ("a/b",)], "public_id string")
    ids = spark.createDataFrame([(corpus.generate()[0]["public_id"],), ("a/b",)], "public_id string")
    found = {r.public_id: r for r in links.provenance(corpus.assets(spark), log, ids).collect()}
    assert found["a/b"].status == "NOT_FOUND" and found["a/b"].derived == 2 and found["a/b"].folder == "a"


def test_polygons(spark):
    side = 0.001
    ring = [["10.000000", "50.000000"], [f"{10 + side:.6f}", "50.000000"], [f"{10 + side:.6f}", f"{50 + side:.6f}"], ["10.000000", f"{50 + side:.6f}"], ["10.000000", "50.000000"]]
    short = [[x.rstrip("0") for x in p] for p in ring]
    rows = [(ring, 5.0), (None, 5.0), (None, 3.0), (short, 5.0), (ring[:-1], 5.0), ([ring[0]] * 4, 5.0)]
    got = spark.createDataFrame(rows, "ring array<array<string>>, ha double").select(polygon.area_ha(F.col("ring")).alias("a"), polygon.polygon_problem(F.col("ring"), F.col("ha")).alias("p")).collect()
    assert got[0].a == pytest.approx(111_195 * side * 111_195 * side * np.cos(np.radians(50)) / 1e4, rel=0.01)
    assert [r.p for r in got] == [None, "polygon_missing", None, "too_few_decimals", "ring_not_closed", "no_area"]


def test_ingest_batches_and_image_limits(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(500)], "path string")
    assert measure.ingest_batches(files, 5).groupBy("batch").count().agg(F.max("count")).first()[0] <= 5
    big = spark.createDataFrame([("big", 10_000, 10_000, b"")], "image_id string, height int, width int, data binary")
    assert measure.measure_images(big).first().error == "too many pixels"
