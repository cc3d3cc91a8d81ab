"""Similarity joins, fits by moments and histograms by counts against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvameter.functions import diagnostics, geometry
from sylvameter.operators import batch, leastsquares, matching, search, similarity
from sylvameter.plans import flows
from sylvameter.sources import scenes


def _alike(texts, threshold):
    """{(a, b): cosine} of all pairs that reach the threshold."""
    tf = {i: Counter(w for w in t.split() if w != "the") for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    unit = {}
    for i, c in tf.items():
        raw = {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        unit[i] = {w: v / norm for w, v in raw.items()}
    found = {(i, j): sum(v * unit[j].get(w, 0.0) for w, v in unit[i].items()) for i in unit for j in unit if i != j}
    return {k: s for k, s in found.items() if s >= threshold - 1e-9}


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_similar_documents(spark, threshold):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    base = [list(rng.choice(words, 12, p=odds / odds.sum())) for _ in range(14)]
    texts = {}
    for i in range(60):
        own = list(base[i % 14])
        for _ in range(i // 14):
            own[rng.integers(12)] = str(rng.choice(words))
        texts[i] = " ".join(own)
    texts |= {100 + i: texts[3] for i in range(25)} | {200: "", 201: "the the", 202: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    want = _alike({i: t or "" for i, t in texts.items()}, threshold)
    found, links = similarity.similar_documents(df, threshold)
    got = {r.doc_id: (r.class_id, r.n_links) for r in found.collect()}
    assert set(got) == set(texts) - {200, 201, 202}
    assert {i: n for i, (_, n) in got.items()} == {i: sum(a == i for a, _ in want) for i in got}
    assert all(got[100 + i][0] == 3 for i in range(25)) and all(texts[c].split() and sorted(texts[c].split()) == sorted(texts[i].split()) for i, (c, _) in got.items())
    members = {c: [i for i, (k, _) in got.items() if k == c] for c, _ in got.values()}
    expanded = {(i, j) for r in links.collect() for i in members[r.a] for j in members[r.b]}
    same = {(i, j) for m in members.values() for i in m for j in m if i != j}
    assert {*expanded, *((j, i) for i, j in expanded), *same} == set(want)
    ranked = {}
    for (i, j), s in want.items():
        ranked.setdefault(i, []).append((-round(s, 8), j))
    best = {(i, r): j for i, x in ranked.items() for r, (_, j) in enumerate(sorted(x)[:4], 1)}
    assert {(r.doc_id, r["rank"]): r.other_id for r in similarity.most_similar(df, threshold, 4).collect()} == best
    assert similarity.most_similar(df.limit(0), threshold).count() == 0


def test_blocks_of_documents_lose_no_link(spark, monkeypatch):
    """Documents of many blocks, and leading terms by small portions: as in one block, and as all pairs."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(90)]
    texts = {i: " ".join(rng.choice(words, 9)) for i in range(70)}
    texts |= {100 + i: f"{texts[i]} {words[i]}" for i in range(40)} | {200 + i: texts[i] for i in range(10)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(similarity, "BLOCK", 700)
    monkeypatch.setattr(similarity, "AT_ONCE", 7)
    found, links = similarity.similar_documents(df, 0.5)
    want = _alike(texts, 0.5)
    assert similarity.packed(df).count() > 3 and len(want) > 100
    got = {r.doc_id: (r.class_id, r.n_links) for r in found.collect()}
    assert {i: n for i, (_, n) in got.items()} == {i: sum(a == i for a, _ in want) for i in texts}
    scores = {(r.a, r.b): r.score for r in links.collect()}
    firsts = {c for c, _ in got.values()}
    assert scores == pytest.approx({(a, b): x for (a, b), x in want.items() if a < b and {a, b} <= firsts})


def test_prefixes_are_short(spark):
    """Common terms do not lead, so documents never meet by them."""
    texts = [(i, "common plain usual word " + f"own{i} rare{i // 2}") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = search.term_counts(df)
    weights = search.idf(counts, 40)
    leading = {r.term for r in similarity.prefixes(search.vectors(counts, weights), weights, 0.6).collect()}
    assert leading and not leading & {"common", "plain", "usual", "word"}


def test_affine_fit_is_that_of_the_design_matrix(spark):
    rng = np.random.default_rng(9)
    groups = {
        "plane": rng.normal(size=(50, 4)) * [3, 1e3, 5, 7] + [1e6, -4, 0, 1e5], "exact": None, "line": None, "point": np.tile([2.0, 3.0, 0, 0], (6, 1)) + np.arange(6)[:, None] * [0, 0, 1, 2],
        "two": rng.normal(size=(2, 4)),
    }
    xy = rng.normal(size=(30, 2))
    groups["exact"] = np.column_stack([xy, xy @ [2.0, -1.0] + 5, xy @ [0.5, 3.0] - 2])
    t = rng.normal(size=20)
    groups["line"] = np.column_stack([t, 2 * t + 1, rng.normal(size=20), t * 3])
    rows = [(k, *map(float, p)) for k, pts in groups.items() for p in pts] + [("plane", None, 1.0, 1.0, 1.0), ("none", None, None, None, None)]
    got = {r.g: r for r in leastsquares.affine_fit(spark.createDataFrame(rows, "g string, x double, y double, u double, v double"), "g").collect()}
    assert set(got) == set(groups)
    for k, pts in groups.items():
        want = geometry.affine_residual(pts[:, :2], pts[:, 2:])
        assert got[k].rms == want if math.isinf(want) else got[k].rms == pytest.approx(want, rel=1e-6, abs=1e-6), k
    e = got["exact"]
    assert [e.ux, e.uy, e.u0, e.vx, e.vy, e.v0] == pytest.approx([2, -1, 5, 0.5, 3, -2])


def test_histograms_match_by_counts(spark):
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for g in range(3):
        a, b = rng.integers(0, 40, 70 + g).astype(np.uint8), rng.integers(20, 90, 30).astype(np.uint8)
        to = diagnostics.match_histogram(a.reshape(-1, 1, 1), b.reshape(-1, 1, 1)).ravel()
        want |= {(g, int(x)): int(y) for x, y in zip(a, to, strict=True)}
        rows += [(g, True, int(x)) for x in a] + [(g, False, int(x)) for x in b]
    rows += [(7, True, 1), (8, False, 2)]
    got = matching.match_histograms(spark.createDataFrame(rows, "g long, source boolean, v long"), "g").collect()
    assert {(r.g, r.v): r.matched for r in got} == want


def test_percentiles_by_every_rule(spark):
    rng = np.random.default_rng(12)
    values = {"a": [float(x) for x in rng.integers(0, 9, 25)], "b": [float(x) for x in rng.normal(size=25)]}
    rows = [(g, *v) for g, n in (("x", 25), ("y", 5)) for v in list(zip(values["a"], values["b"], strict=True))[:n]] + [("x", None, None), ("z", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    rules = {
        "nearest": lambda q, n: min(n - 1, max(0, round(q * n) - 1)), "above": lambda q, n: min(n - 1, int(q * n)),
        "whole": lambda q, n: min(n, max(1, -(-int(round(q * 100, 6) * n) // 100))) - 1,
    }
    quantiles = (0.5, 0.9, 0.95, 0.99)
    for rule, place in rules.items():
        got = {(r.g, r.metric): tuple(r)[2:] for r in batch.percentiles(df, ("a", "b"), quantiles, rule, "g").collect()}
        want = {}
        for g in "xyz":
            for i, m in enumerate("ab"):
                own = sorted(r[i + 1] for r in rows if r[0] == g and r[i + 1] is not None)
                if own:
                    want[g, m] = (len(own), *[own[place(q, len(own))] for q in quantiles], own[0], own[-1])
        assert got == want, rule


def test_bulk_run_with_odd_images(spark):
    """Broken, huge, missing and unregistered inputs are rows with a reason, and the counts add up."""
    good = scenes.scene(1, 48, 64, 30).tobytes()
    points = [(float(x), float(y), float(x + 2), float(y + 1), 0.5) for x in range(0, 120, 20) for y in range(0, 120, 20)]
    images = [
        ("0", 48, 64, good, good, points), ("1", 48, 64, b"x", None, None), ("2", 48, None, good, None, None), ("3", 100_000, 100_000, good, None, None), ("4", None, None, None, None, None),
        ("5", 48, 64, good, None, points[:3]), ("6", 48, 64, good, b"short", []), ("9", 48, 64, good, None, None),
    ]
    df = spark.createDataFrame(images, "asset_id string, height int, width int, data binary, before binary, points array<struct<sx:double,sy:double,dx:double,dy:double,ratio:double>>")
    assets = spark.createDataFrame([(str(i), i, "2026-09-22", 1.0, 2.0, "C2PA_VERIFIED") for i in range(9)], "asset_id string, number int, capture_timestamp string, latitude double, longitude double, c2pa_provenance string")
    rows = {r.asset_id: r for r in batch.bulk(assets, df, "number").collect()}
    assert set(rows) == {str(i) for i in range(9)}
    assert (rows["0"].status, rows["0"].change_pct, rows["0"].registration, rows["0"].trust, rows["0"].forgery) == ("INGESTED", 0.0, "OK", "trusted", "REVIEW_REPLAY" if rows["0"].moire > 4.2 else "NATURAL")
    assert [rows[i].error for i in "1234"] == ["no readable pixels", "no readable pixels", "too many pixels", "no readable pixels"]
    assert rows["5"].registration == "TOO_FEW_POINTS" and rows["5"].change_pct is None and rows["6"].canopy_status is None and rows["7"].status is None and rows["7"].verdict
    report = batch.report(batch.bulk(assets, df, "number")).collect()
    assert sum(r.n for r in report) == 9 and sum(r.rejected for r in report) == 4 and sum(r.trusted for r in report) == 1


def test_bulk_run_broadcasts_no_images(spark, data):
    """Neither image bytes nor what was measured on them goes through the driver, however small the table of assets looks."""
    for name in ("bulk_verdicts", "bulk_percentiles"):
        plan = flows.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 1, name


def test_samples_of_four_have_their_homography():
    rng = np.random.default_rng(10)
    src = rng.uniform(-2, 2, (200, 4, 2))
    for h, p in zip(geometry.exact_homographies(src, src[::-1]), zip(src, src[::-1], strict=True), strict=True):
        assert np.abs(geometry.project(h, p[0]) - p[1]).max() < 1e-5
