"""Registered queries: sun and shadow, biomass, duplicates, intervals, tags, grounding and notifications."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvameter.functions import biomass, imaging, solar
from sylvameter.functions import text as text_functions
from sylvameter.operators import batch, dedup, grounding, intervals, leastsquares, links, matching, measure, tagging
from sylvameter.session import spread
from sylvameter.sources import scenes
from sylvameter.sources.tables import table
from sylvameter.streaming import notifications

Query = Callable[[SparkSession, str], DataFrame]


def _captures(spark: SparkSession, d: str) -> DataFrame:
    """Events as captures somewhere on earth, a tenth without an observed shadow."""
    return table(spark, d, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 120 - 60).cast("double").alias("latitude"),
        (F.col("user_id") * 7 % 360 - 180).cast("double").alias("longitude"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.pmod(F.col("value") * 3.6, F.lit(360.0))).alias("observed"),
    )


def _sun(spark: SparkSession, d: str) -> DataFrame:
    return solar.with_shadow_verdict(solar.with_sun(_captures(spark, d)))


def solar_position(spark: SparkSession, d: str) -> DataFrame:
    return _sun(spark, d).select("event_id", F.round("sun_azimuth", 3).alias("sun_azimuth"), F.round("sun_elevation", 3).alias("sun_elevation"))


def shadow_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _sun(spark, d).select(
        "event_id", F.round("expected_shadow", 3).alias("expected_shadow"), F.round("angular_error", 3).alias("angular_error"), "verdict",
        solar.triage(F.col("verdict"))["decision"].alias("decision"),
    )


def verdict_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Every third capture counts as one of sound provenance."""
    judged = _sun(spark, d).withColumn("decision", solar.triage(F.col("verdict"))["decision"])
    sound = F.when(F.col("event_id") % 3 == 0, "C2PA_VERIFIED").otherwise("C2PA_MISSING")
    return batch.tallies(judged.withColumn("c2pa_provenance", sound))


def time_of_day(spark: SparkSession, d: str) -> DataFrame:
    seen = _sun(spark, d).where("observed is not null and sun_elevation > 10")
    return seen.withColumn("r", solar.time_of_day_report(F.col("observed"), F.col("sun_azimuth"))).select("event_id", "r.implied_half", "r.actual_half", "r.inconsistent")


def allometry(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    kg = biomass.stem_biomass(0.3 + (size % 5) * 0.1, biomass.stem_diameter(size.cast("double")), price / 200)
    return table(spark, d, "part").select("p_partkey", F.round(kg, 6).alias("stem_kg"), F.round(biomass.co2_tonnes(kg), 8).alias("stem_t"))


def allometry_stand(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    kg = biomass.stem_biomass(F.lit(0.45), biomass.stem_diameter(size.cast("double")), price / 200)
    stand = biomass.co2_tonnes(kg, F.lit(1100), size / 10)
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum(stand), 4).alias("stand_t"), F.count("*").alias("n"))


def _supplier_errors(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("sd"), F.sum("l_extendedprice").alias("gross"))
    return by.withColumn("error", biomass.sampling_error_pct(F.col("n"), F.col("mean"), F.col("sd")) * 6)


def sampling_error(spark: SparkSession, d: str) -> DataFrame:
    return _supplier_errors(spark, d).select("l_suppkey", "n", F.round("error", 4).alias("error_pct"))


def vm0047_discount(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("error")
    return _supplier_errors(spark, d).select(
        "l_suppkey", F.round(biomass.discount_pct(e), 4).alias("discount_pct"), biomass.discount_status(e).alias("status"),
        F.round(biomass.net_certified(F.col("gross"), e), 2).alias("net"),
    )


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("asset_id"), dedup.sign_bits(F.slice(v, 33, 32), 32).alias("hi"), dedup.sign_bits(v, 32).alias("lo"),
        F.col("label").cast("string").alias("project_id"), F.col("vec_id").alias("seq"),
    )


def phash_nearest(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    return dedup.nearest(h, h, earlier_only=True).select("asset_id", "match_id", "distance")


def phash_scoped(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    return dedup.nearest(h, h, same_project=True, earlier_only=True).select("asset_id", "match_id", "distance")


def phash_verdict(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    found = dedup.nearest(h, h, earlier_only=True, most_distance=dedup.REVIEW)
    return found.groupBy(dedup.verdict(F.col("distance")).alias("verdict")).agg(F.count("*").alias("n"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user on a day as tag intervals of a video, from its start in seconds."""
    ts = F.col("ts").cast("timestamp")
    day = F.date_format(ts, "yyyy-MM-dd")
    start = F.round(F.pmod(F.unix_micros(ts), F.lit(86_400_000_000)) / 1e6, 3)
    return table(spark, d, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), day).alias("video_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tag"),
        start.alias("start"), F.round(start + F.col("value") * 60, 3).alias("end"), (0.5 + (F.col("event_id") % 50) / 100).alias("confidence"),
    )


def sweep_cues(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.cues(_segments(spark, d))
    return found.select("video_id", "cue", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.array_join("lines", "|").alias("lines"))


def caption_check(spark: SparkSession, d: str) -> DataFrame:
    """Sound documents, and by the length of the document some with a fault put in."""
    documents = intervals.caption_documents(intervals.cues(_segments(spark, d)))
    kind = F.length("vtt") % 5
    faulty = (
        F.when(kind == 1, F.concat(F.lit("x"), "vtt")).when(kind == 2, F.lit("WEBVTT\n"))
        .when(kind == 3, F.concat("vtt", F.lit("\n9\n00:00:05.000 --> 00:00:04.000\nx\n"))).when(kind == 4, F.concat("vtt", F.lit("\n9\nnever --> 99:00:00.000\nx\n")))
        .otherwise(F.col("vtt"))
    )
    problems = intervals.caption_problems(faulty)
    return documents.select("video_id", F.array_join(F.array_sort(problems), " ").alias("problems"), F.length("vtt").cast("long").alias("n_chars"))


def video_tags(spark: SparkSession, d: str) -> DataFrame:
    return intervals.tags_by_video(_segments(spark, d)).select("video_id", F.array_join("tags", ",").alias("tags"))


def surest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cues with one line, the surest."""
    found = intervals.cues(_segments(spark, d), most_lines=1)
    return found.select("video_id", "cue", F.array_join("lines", "|").alias("line"))


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return intervals.hotspots(_segments(spark, d)).select("video_id", "number", "hotspot_id", "title", "start", "end", "description")


def active_at(spark: SparkSession, d: str) -> DataFrame:
    return intervals.active_at(_segments(spark, d), 43_200.0, intervals.SLACK).select("video_id", "seq", "tag", "start", "end")


def vtt_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text_functions.caption_time(F.col("value") * 997).alias("stamp"))


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """Parts as images: measures from the key, in steps that no rounding tie can reach."""
    def share(factor: int, modulus: int, scale: float):
        return (F.col("p_partkey") * factor % modulus / scale).cast("double")

    return table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") > 5).alias("detectable"), share(7, 97, 113.0).alias("cover"), share(3, 89, 130.0).alias("green"),
        share(5, 83, 130.0).alias("yellow"), share(11, 79, 130.0).alias("brown"), share(13, 73, 330.0).alias("magenta"), share(17, 71, 430.0).alias("water"),
        share(19, 67, 170.0).alias("sky"), share(23, 61, 230.0).alias("edges"), share(29, 181, 1.3).alias("luma_mean"), share(31, 83, 1.1).alias("luma_std"),
    )


def tag_rules(spark: SparkSession, d: str) -> DataFrame:
    tags = tagging.long_form(_measures(spark, d).withColumn("tags", tagging.pixel_tags()), "tags", "p_partkey").select("h.tag", "h.confidence")
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("confidence"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    sure = (F.col("p_partkey") % 10 / 10 + 0.03).cast("double")
    outside = F.create_map(F.lit("River"), sure, F.lit("cloud"), (1.0 - sure / 2), F.lit("bridge"), F.lit(0.97), F.lit("unicorn"), F.lit(0.99))
    return tagging.enrich(_measures(spark, d).withColumn("outside", outside), "outside")


def tag_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = tagging.long_form(_fused(spark, d), "tags", "p_partkey")
    return rows.groupBy("h.tag", "h.evidence").agg(F.count("*").alias("n"), F.round(F.sum("h.confidence"), 2).alias("confidence"))


def tag_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return tagging.long_form(_fused(spark, d), "conflicts", "p_partkey", name="c").select("p_partkey", "c.tag", F.round("c.external_confidence", 3).alias("external_confidence"))


def number_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" Under VM0047, 1,234.5 t and "), F.col("n_chars").cast("string"), F.lit(" of 12% tCO2e, Article 9."))
    found = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars")).select("doc_id", text_functions.figures(text).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.least(F.coalesce(F.abs(text_functions.figure_value(x)), F.lit(0.0)), F.lit(1e6)))
    return found.select("doc_id", F.size("f").cast("long").alias("n"), F.round(total, 2).alias("total"))


def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """Claims about the length of a text: right, wrong by one, or with a figure that is no fact."""
    claimed = F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    more = F.when(F.col("doc_id") % 4 == 0, F.lit(", and 0.5 ha.")).otherwise(F.lit("."))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("VM0047: the text has "), claimed.cast("string"), F.lit(" characters"), more).alias("claim"))
    judged = grounding.check(docs, "claim", ["n_chars"])
    return judged.select("doc_id", F.array_join("ungrounded", " ").alias("ungrounded"), "grounded")


def project_summary(spark: SparkSession, d: str) -> DataFrame:
    """Priorities as projects; a fact is missing for some of them, and the cap on sentences is met."""
    status = F.col("o_orderstatus")
    facts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("project_name")).agg(
        F.count("*").alias("total"), F.count_if(status == "F").alias("verified"), F.count_if(status == "P").alias("quarantined"), F.count_if(status == "O").alias("review"),
    )
    rank = F.substring("project_name", 1, 1).cast("int")
    facts = facts.withColumns({
        "canopy_delta_pct": F.when(rank != 2, rank * 1.5 - 4), "mean_inlier_ratio": rank * 0.2, "net_certified_tco2e": F.when(rank != 3, rank * 10.0),
        "sampling_error_pct": rank + 0.25, "area_ha": F.lit(14.5),
    })
    return grounding.summary(facts).select("project_name", "summary")


def label_quality(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").select(F.lit("good").alias("kind"), "lang")
    bare = docs.join(labels, "doc_id", "left_anti").select(F.lit("unlabelled").alias("kind"), "lang")
    return good.unionByName(bare).groupBy("kind", "lang").agg(F.count("*").alias("n"))


def ratio_test_knn(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest descriptors of every twentieth one, kept if the first is clearly nearer than the second."""
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return matching.ratio_test(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), scaled.alias("v")), F.col("id") % 20 == 0)


def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Callers above one call in a minute, of events that come sixty times as fast as they did."""
    fast = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60))
    over = notifications.over_limit(table(spark, d, "events").withColumn("at", fast), "user_id", "at", 1)
    return over.select(F.col("key").alias("user_id"), F.unix_seconds("minute").alias("minute"), "n", "rejected", "retry_after")


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """Events as signed notifications without an id; some are stale, some signed wrongly or not at all."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    payload = F.struct(
        F.concat(F.lit("u"), F.col("user_id")).alias("public_id"), k.alias("version"),
        F.when(kind == "view", "eager").when(kind == "purchase", "upload").when(kind == "signup", "video").otherwise(kind).alias("notification_type"),
    )
    at, number = F.col("ts").cast("timestamp"), F.col("event_id")
    stamp = (F.unix_seconds(at) - F.when(number % 7 == 0, 7201).otherwise(7200)).cast("string")
    rows = table(spark, d, "events").select(number, F.to_json(payload).cast("binary").alias("body"), stamp.alias("stamp"), at.alias("received_at"))
    good = notifications.signature(F.col("body"), F.col("stamp"), "secret")
    given = F.when(number % 11 == 0, F.lit(" ")).when(number % 5 == 0, F.reverse(good)).otherwise(F.upper(good))
    return rows.withColumn("headers", F.create_map(F.lit("X-Cld-Signature"), given, F.lit("X-CLD-Timestamp"), F.col("stamp")))


def notification_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Status of signed notifications that are known by public id, version and kind."""
    done = notifications.process(_signed(spark, d), "secret")
    return done.groupBy("status", notifications.http_status(F.col("status")).alias("http")).agg(F.count("*").alias("n"))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return notifications.verified(_signed(spark, d), "secret").groupBy("ok", "reason").agg(F.count("*").alias("n"))


def handler_counts(spark: SparkSession, d: str) -> DataFrame:
    """Unsigned notifications by kind, those of no handler aside."""
    rows = notifications.judged(_signed(spark, d), None)
    return rows.groupBy("kind", "status").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("|", F.col("event_id").cast("string"), "props").cast("binary")
    return table(spark, d, "events").select("event_id", notifications.signature(body, F.lit("1700000000"), "secret", "sha256").alias("signature"))


def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Otsu's threshold of each vector, its components taken as the bytes of an index image."""
    def cut(batches):
        for pdf in batches:
            values = [np.clip((np.asarray(v, np.float64) + 1) * 127.5, 0, 255).astype(np.uint8) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "threshold": [imaging.otsu(v) for v in values]})

    rows = table(spark, d, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    return rows.mapInPandas(cut, "vec_id long, threshold long")


def median_gains(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    m = lambda s: F.median(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    got = o.groupBy("o_orderpriority").agg(m("F").alias("a"), m("O").alias("b"))
    gain = F.col("a") / F.col("b")
    status = F.when((gain > 3) | (gain < 1 / 3), "REFUSED").when(F.abs(gain - 1) <= 0.02, "NOOP").otherwise("CORRECTED")
    return got.select("o_orderpriority", F.round(gain, 6).alias("gain"), status.alias("status"))


def histogram_match(spark: SparkSession, d: str) -> DataFrame:
    """By supplier, what the quantities of returned lines become when they are matched to those of others."""
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "N", False)
    rows = table(spark, d, "lineitem").select("l_suppkey", flag.alias("source"), F.col("l_quantity").cast("int").cast("long").alias("v"))
    return matching.match_histograms(rows.where("source is not null"), "l_suppkey")


def affine_residual(spark: SparkSession, d: str) -> DataFrame:
    """By supplier: what the best affine map of (quantity, 0) to (price, 0) leaves, as a root mean square."""
    quantity, price, none = F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("u"), F.lit(0.0)
    points = table(spark, d, "lineitem").select("l_suppkey", quantity, none.alias("y"), price, none.alias("v"))
    return leastsquares.affine_fit(points, "l_suppkey").select("l_suppkey", F.round("rms", 2).alias("rms"))


def supplier_assets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as assets near the equator at the equinox, where the height of the sun follows from the hour."""
    number = F.col("s_suppkey")
    return spread(table(spark, d, "supplier").select(
        number.cast("string").alias("asset_id"), number.alias("number"), F.lit("2026-09-22").alias("capture_timestamp"),
        (F.col("s_nationkey") % 21 - 10).cast("double").alias("latitude"), (F.col("s_nationkey") * 14 - 170).cast("double").alias("longitude"),
        F.when(number % 3 == 0, "C2PA_VERIFIED").otherwise("C2PA_MISSING").alias("c2pa_provenance"), number.alias("seed"),
        F.when(number % 23 == 1, -1).otherwise(12 + number % 41).alias("green"), (14 + number % 29).alias("green_before"),
    ))


def demo_batch(spark: SparkSession, d: str) -> DataFrame:
    """The sun stage of the bulk run: a tenth of the assets with a turned shadow, a tenth at low sun."""
    return batch.tallies(batch.run(supplier_assets(spark, d), "number"))


def demo_campaign(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects and their orders as captures: links made of the first and the latest of each."""
    key = F.col("o_custkey").cast("string")
    assets = table(spark, d, "orders").select(
        key.alias("esg_project_id"), F.concat_ws("/", F.lit("impact"), key, F.col("o_orderkey").cast("string")).alias("public_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("capture_timestamp"), F.round(F.col("o_totalprice") / 1000, 1).alias("canopy_delta_pct"),
        F.when(F.col("o_orderstatus") == "F", "C2PA_VERIFIED").otherwise("C2PA_MISSING").alias("c2pa_provenance"),
    )
    projects = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return links.campaign(assets, projects, "https://media.example.org/demo").select("id", "split_url", "reel_url")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _supplier_errors(spark, d).select(
        F.concat(F.lit("SUP-"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0")).alias("project_id"), F.lit("evidence/plate").alias("public_id"),
        F.round(F.col("gross") / 1e6, 2).alias("tonnes"), F.round("error", 1).alias("error"), F.lit("0123456789abcdef").alias("root"),
    )
    return links.report(rows, "https://media.example.org/demo", "https://app.example.org/").select("project_id", "problem", "record_url")


def image_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures, hashes and tags of scenes that are drawn for the suppliers, some of them unreadable."""
    drawn = scenes.render(supplier_assets(spark, d), 96, 64).withColumnRenamed("asset_id", "image_id")
    found = measure.measure_images(drawn)
    return found.withColumn("tags", F.transform(tagging.by_confidence(tagging.pixel_tags()), lambda h: h["tag"])).select("image_id", "status", "phash", "tags")


def notification_results(spark: SparkSession, d: str) -> DataFrame:
    """Events as unsigned notifications through the whole of the processor, in batch."""
    ts = F.col("ts").cast("timestamp")
    body = F.to_json(F.struct(
        F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("notification_id"),
        F.when(F.col("event_type") == "click", "other").otherwise("upload").alias("notification_type"),
    ))
    rows = table(spark, d, "events").select(body.cast("binary").alias("body"), F.create_map().cast("map<string,string>").alias("headers"), ts.alias("received_at"))
    return notifications.process(rows, None).groupBy("status").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        solar_position, shadow_verdict, verdict_tallies, time_of_day, allometry, allometry_stand, sampling_error, vm0047_discount, phash_nearest, phash_scoped,
        phash_verdict, sweep_cues, video_tags, surest_lines, caption_check, hotspots, active_at, vtt_timestamp, tag_rules, tag_fusion, tag_conflicts, number_extract, grounding_check,
        project_summary, label_quality, ratio_test_knn, rate_limit_window, notification_dedup, freshness, handler_counts, signatures, otsu_threshold,
        median_gains, histogram_match, affine_residual, demo_batch, demo_campaign, report_rows, image_measures, notification_results,
    )
}


def _mod(x: str, m: str) -> str:
    return f"(({x}) - {m} * floor(({x}) / {m}))"


_SUN = f"""
c AS (SELECT event_id, epoch_us(ts)::DOUBLE AS us, (user_id % 120 - 60)::DOUBLE AS lat, (user_id * 7 % 360 - 180)::DOUBLE AS lon,
        CASE WHEN event_id % 10 <> 0 THEN {_mod("value * 3.6e0", "360e0")} END AS observed FROM events),
s1 AS (SELECT *, (us / 86400e6 + 2440587.5e0 - 2451545e0) / 36525e0 AS t FROM c),
s2 AS (SELECT *, {_mod("280.46646e0 + t * (36000.76983e0 + t * 0.0003032e0)", "360e0")} AS l, 357.52911e0 + t * (35999.05029e0 - 0.0001537e0 * t) AS m,
        0.016708634e0 - t * (0.000042037e0 + 0.0000001267e0 * t) AS e, 125.04e0 - 1934.136e0 * t AS w FROM s1),
s3 AS (SELECT *, l + sin(radians(m)) * (1.914602e0 - t * (0.004817e0 + 0.000014e0 * t)) + sin(radians(2 * m)) * (0.019993e0 - 0.000101e0 * t) + sin(radians(3 * m)) * 0.000289e0
        - 0.00569e0 - 0.00478e0 * sin(radians(w)) AS a,
        23e0 + (26e0 + (21.448e0 - t * (46.815e0 + t * (0.00059e0 - t * 0.001813e0))) / 60e0) / 60e0 + 0.00256e0 * cos(radians(w)) AS o FROM s2),
s4 AS (SELECT *, asin(sin(radians(o)) * sin(radians(a))) AS dec, pow(tan(radians(o / 2)), 2e0) AS y FROM s3),
s5 AS (SELECT *, 4e0 * degrees(y * sin(radians(2 * l)) - 2 * e * sin(radians(m)) + 4 * e * y * sin(radians(m)) * cos(radians(2 * l)) - 0.5e0 * y * y * sin(radians(4 * l)) - 1.25e0 * e * e * sin(radians(2 * m))) AS q FROM s4),
s6 AS (SELECT *, radians({_mod("(us - 86400e6 * floor(us / 86400e6)) / 60e6 + q + 4 * lon", "1440e0")} / 4 - 180) AS h, radians(lat) AS phi FROM s5),
s7 AS (SELECT *, degrees(asin(least(1e0, greatest(-1e0, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(h))))) AS el,
        {_mod("degrees(atan2(sin(h), cos(h) * sin(phi) - tan(dec) * cos(phi))) + 180e0", "360e0")} AS az FROM s6),
s8 AS (SELECT *, CASE WHEN observed IS NULL THEN 0e0 ELSE {_mod("az + 180e0", "360e0")} END AS shadow FROM s7),
s9 AS (SELECT *, CASE WHEN observed IS NULL THEN 180e0 ELSE least({_mod("observed - shadow", "360e0")}, 360e0 - {_mod("observed - shadow", "360e0")}) END AS err FROM s8),
sun AS (SELECT *, CASE WHEN observed IS NULL THEN 'REVIEW_INSUFFICIENT_EVIDENCE' WHEN el < 0 THEN 'QUARANTINE_NIGHTTIME_CAPTURE_ANOMALY' WHEN el < 10 THEN 'REVIEW_LOW_SUN_UNDETERMINED'
        WHEN err <= 12 THEN 'PHYSICS_PASS' ELSE 'QUARANTINE_SOLAR_MISMATCH' END AS verdict FROM s9)"""
_KG = "0.0673e0 * pow({rho} * (4.41e0 * p_size) * (p_retailprice / 200), 0.976e0)"
_Z = 1.6448536269514722
_T = f"""(CASE n - 1 WHEN 1 THEN 6.3138e0 WHEN 2 THEN 2.92e0 WHEN 3 THEN 2.3534e0 WHEN 4 THEN 2.1318e0 ELSE
  {_Z}e0 + {(_Z**3 + _Z)!r}e0 / (4 * (n - 1)) + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z)!r}e0 / (96 * pow(n - 1, 2)) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z)!r}e0 / (384 * pow(n - 1, 3)) END)"""
_ERRORS = f"""
s AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1),
errors AS (SELECT *, CASE WHEN n >= 2 AND mean <> 0 THEN {_T} * sd / (sqrt(n) * mean) * 100 * 6 END AS err FROM s)"""
_BITS = "list_reduce([CASE WHEN embedding[{0} + i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END FOR i IN range(1, 33)], lambda a, b: a + b)"
_HASHES = f"""h AS (SELECT vec_id, label, {_BITS.format(32)} AS hi, {_BITS.format(0)} AS lo FROM embeddings),
pairs AS (SELECT a.vec_id AS asset_id, b.vec_id AS match_id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INTEGER AS d, a.label = b.label AS same FROM h a JOIN h b ON b.vec_id < a.vec_id)"""


def _nearest(condition: str) -> str:
    return f"""
WITH {_HASHES}, best AS (SELECT * FROM pairs WHERE d < 64 AND {condition} QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY d, match_id) = 1)
SELECT vec_id AS asset_id, match_id, d AS distance FROM h LEFT JOIN best ON asset_id = vec_id"""


_SEGMENTS = """seg AS (
  SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS video_id, event_id AS seq, event_type AS tag, round((epoch_us(ts) % 86400000000) / 1e6, 3) AS a,
         round(round((epoch_us(ts) % 86400000000) / 1e6, 3) + value * 60, 3) AS b, 0.5e0 + (event_id % 50) / 100e0 AS conf FROM events)"""
_CUES = f"""{_SEGMENTS}, edges AS (SELECT video_id, a AS x FROM seg UNION SELECT video_id, b FROM seg),
w AS (SELECT video_id, x, lead(x) OVER (PARTITION BY video_id ORDER BY x) AS y FROM edges),
act AS (SELECT w.video_id, x, y, tag, min((-conf, seq)) AS k FROM w JOIN seg s ON s.video_id = w.video_id AND a <= x AND b >= y AND conf >= 0.6e0 WHERE y - x >= 0.8e0 GROUP BY ALL),
cues AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY x) AS cue, x AS a, least(y, x + 60) AS b, string_agg(tag, '|' ORDER BY k) AS lines FROM act GROUP BY video_id, x, y)"""
_SHARE = "(p_partkey * {} % {} / {}e0)"
_MEASURES = "m AS (SELECT p_partkey, p_size > 5 AS detectable, " + ", ".join(
    f"{_SHARE.format(f, m, s)} AS {name}"
    for name, f, m, s in (
        ("cover", 7, 97, "113"), ("green", 3, 89, "130"), ("yellow", 5, 83, "130"), ("brown", 11, 79, "130"), ("magenta", 13, 73, "330"),
        ("water", 17, 71, "430"), ("sky", 19, 67, "170"), ("edges", 23, 61, "230"), ("luma_mean", 29, 181, "1.3"), ("luma_std", 31, 83, "1.1"),
    )
) + " FROM part)"
_HITS = f"{_MEASURES}, hits AS (" + " UNION ALL ".join(
    f"SELECT p_partkey, '{tag}' AS tag, round(greatest(least(({confidence})::DOUBLE, 1e0), 0e0), 3) AS confidence FROM m WHERE {condition}" for tag, condition, confidence in tagging.PIXEL_RULES
) + ")"


def _has(tag: str) -> str:
    return f"list_contains(t, '{tag}')"


_FUSED = f"""{_HITS}, sets AS (SELECT m.p_partkey, coalesce(list(tag) FILTER (tag IS NOT NULL), []) AS t FROM m LEFT JOIN hits USING (p_partkey) GROUP BY 1),
inferred AS (""" + " UNION ALL ".join(
    f"SELECT p_partkey, '{tag}' AS tag, {c}e0 AS confidence FROM sets WHERE " + " AND ".join([_has(x) for x in having] + [f"NOT {_has(x)}" for x in lacking])
    for tag, having, lacking, c in tagging.INFERRED
) + """), local AS (SELECT *, 'PIXEL' AS evidence FROM hits UNION ALL SELECT *, 'INFERRED' FROM inferred),
outside AS (SELECT p_partkey, 'water' AS tag, p_partkey % 10 / 10e0 + 0.03e0 AS c FROM part UNION ALL SELECT p_partkey, 'overcast', 1e0 - (p_partkey % 10 / 10e0 + 0.03e0) / 2 FROM part
  UNION ALL SELECT p_partkey, 'infrastructure', 0.97e0 FROM part),
fused AS (SELECT * FROM local UNION ALL SELECT p_partkey, tag, round(least(c, 0.9e0), 3), 'EXTERNAL' FROM outside o WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.p_partkey = o.p_partkey AND l.tag = o.tag))"""
_FIGURES = r"""masked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text || ' Under VM0047, 1,234.5 t and ' || n_chars || ' of 12% tCO2e, Article 9.',
  '\b(?:VM|C2PA|CSRD|EUDR|ESRS|ISO|IEC|ISSA|IPCC|GRI)(?:\s*/\s*(?:IEC|ISO|ISSA))?[-\s/]?[A-Z]?\d+[A-Za-z0-9.]*\b', '~', 'g'), '\b[tT]?CO2e?', '~', 'g'),
  '\b(?:Article|Section|Clause|Annex|Paragraph|Chapter|Schedule)\s+\d+(?:\.\d+)?', '~', 'g'), '\bE[1-9]\b', '~', 'g'), '\bC2PA\b', '~', 'g'), '\b(?:cm2|m2|ha|kg|ms|fps|ppm)\b', '~', 'g') AS text FROM documents),
f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[+-]?\d[\d,]*(?:\.\d+)?\s*%?'), lambda x: least(abs(coalesce(try_cast(regexp_replace(x, '[,%\s]', '', 'g') AS DOUBLE), 0)), 1e6)) AS v FROM masked)"""

_NOTES = """notes AS (SELECT *, CASE WHEN reason <> 'verified' THEN 'REJECTED_UNVERIFIED' WHEN kind IN ('eager', 'upload', 'video') THEN 'ACCEPTED' ELSE 'IGNORED_UNHANDLED' END AS status FROM (
  SELECT ts, 'u' || user_id || ':' || json_extract_string(props, '$.k') || ':' || kind AS key, kind,
         CASE WHEN event_id % 11 = 0 THEN 'no_signature' WHEN event_id % 7 = 0 THEN 'stale' WHEN event_id % 5 = 0 THEN 'mismatch' ELSE 'verified' END AS reason
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'eager' WHEN 'purchase' THEN 'upload' WHEN 'signup' THEN 'video' ELSE event_type END AS kind FROM events)))"""

ORACLE_SQL: dict[str, str] = {
    "demo_batch": """
SELECT CASE s_suppkey % 10 WHEN 0 THEN 'QUARANTINE_SOLAR_MISMATCH' WHEN 5 THEN 'REVIEW_LOW_SUN_UNDETERMINED' ELSE 'PHYSICS_PASS' END AS verdict, count(*) AS n,
  count(*) FILTER (s_suppkey % 30 = 0) AS contradictions FROM supplier GROUP BY 1""",
    "demo_campaign": """
WITH a AS (SELECT o_custkey AS c, 'impact/' || o_custkey || '/' || o_orderkey AS pid, strftime(o_orderdate, '%Y-%m-%d') AS d, round(o_totalprice / 1000, 1) AS canopy, o_orderstatus = 'F' AS sound FROM orders),
e AS (SELECT c, arg_min(pid, (d, pid)) AS f, arg_max(pid, (d, pid)) AS l, arg_max(canopy, (d, pid)) AS canopy, arg_max(sound, (d, pid)) AS sound FROM a GROUP BY 1)
SELECT c_custkey::VARCHAR AS id,
  'https://media.example.org/demo/image/upload/c_fill,w_1200,h_800/c_crop,w_600,h_800,g_west/l_' || replace(l, '/', ':')
  || '/c_fill,w_1200,h_800/c_crop,w_600,h_800,g_east/l_text:Arial_22_bold:BEFORE,co_white,b_rgb:00000080,g_north_west,x_30,y_30'
  || '/l_text:Arial_22_bold:AFTER,co_white,b_rgb:05966990,g_north_east,x_30,y_30/l_text:Arial_26_black:'
  || url_encode(printf('%+.1f%% CANOPY', canopy) || CASE WHEN sound THEN ' | PROVENANCE VERIFIED' ELSE '' END) || ',co_white,b_rgb:064e3b95,g_south,x_30,y_30/f_auto,q_auto:good/' || f || '.jpg' AS split_url,
  'https://media.example.org/demo/video/upload/ar_9:16,c_fill,g_center/e_sharpen:60/l_text:Arial_34_black:' || url_encode(upper(c_name))
  || ',co_white,b_rgb:059669,g_north,x_0,y_80/l_text:Arial_24_bold:Verified%20evidence,co_white,g_south,x_0,y_60/f_auto,q_auto/' || l || '.mp4' AS reel_url
FROM customer LEFT JOIN e ON c = c_custkey""",
    "solar_position": f"WITH {_SUN} SELECT event_id, round(az, 3) AS sun_azimuth, round(el, 3) AS sun_elevation FROM sun",
    "shadow_verdict": f"""WITH {_SUN} SELECT event_id, round(shadow, 3) AS expected_shadow, round(err, 3) AS angular_error, verdict,
  CASE WHEN verdict = 'PHYSICS_PASS' THEN 'VERIFIED_PASS' WHEN verdict LIKE 'QUARANTINE%' THEN 'QUARANTINE_FRAUD' ELSE 'REVIEW_AMBIGUOUS' END AS decision FROM sun""",
    "verdict_tallies": f"WITH {_SUN} SELECT verdict, count(*) AS n, count(*) FILTER (verdict LIKE 'QUARANTINE%' AND event_id % 3 = 0) AS contradictions FROM sun GROUP BY 1",
    "time_of_day": f"""WITH {_SUN}, i AS (SELECT *, {_mod("observed + 180e0", "360e0")} AS implied FROM sun WHERE observed IS NOT NULL AND el > 10)
SELECT event_id, CASE WHEN implied < 180 THEN 'MORNING' ELSE 'AFTERNOON' END AS implied_half, CASE WHEN az < 180 THEN 'MORNING' ELSE 'AFTERNOON' END AS actual_half,
  (implied < 180) <> (az < 180) AND least({_mod("implied - az", "360e0")}, 360e0 - {_mod("implied - az", "360e0")}) > 12 AS inconsistent FROM i""",
    "allometry": f"WITH k AS (SELECT p_partkey, {_KG.format(rho='(0.3e0 + (p_size % 5) * 0.1e0)')} AS kg FROM part) SELECT p_partkey, round(kg, 6) AS stem_kg, round(kg * (0.47e0 * (44e0 / 12e0) / 1000e0), 8) AS stem_t FROM k",
    "allometry_stand": f"SELECT p_brand, round(sum({_KG.format(rho='0.45e0')} * (0.47e0 * (44e0 / 12e0) / 1000e0) * 1100 * (p_size / 10e0)), 4) AS stand_t, count(*) AS n FROM part GROUP BY 1",
    "sampling_error": f"WITH {_ERRORS} SELECT l_suppkey, n, round(err, 4) AS error_pct FROM errors",
    "vm0047_discount": f"""WITH {_ERRORS} SELECT l_suppkey, round(greatest(err - 15, 0), 4) AS discount_pct,
  CASE WHEN err > 22.5 THEN 'INSUFFICIENT_PRECISION' WHEN err > 15 THEN 'APPLIED' ELSE 'NONE' END AS status, round(gross * (1 - greatest(err - 15, 0) / 100), 2) AS net FROM errors""",
    "phash_nearest": _nearest("true"),
    "phash_scoped": _nearest("same"),
    "phash_verdict": f"SELECT CASE WHEN distance IS NULL OR distance > 12 THEN 'UNIQUE' WHEN distance <= 8 THEN 'QUARANTINE_DUPLICATE' ELSE 'REVIEW_SIMILAR' END AS verdict, count(*) AS n FROM ({_nearest('true')}) GROUP BY 1",
    "sweep_cues": f"WITH {_CUES} SELECT video_id, cue::INTEGER AS cue, round(a, 3) AS start, round(b, 3) AS \"end\", lines FROM cues",
    "video_tags": f"WITH {_SEGMENTS} SELECT video_id, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (conf >= 0.6e0), '') AS tags FROM seg GROUP BY 1",
    "surest_lines": f"WITH {_CUES} SELECT video_id, cue::INTEGER AS cue, split_part(lines, '|', 1) AS line FROM cues",
    "caption_check": f"""WITH {_CUES}, t AS (SELECT video_id, (8 + sum(length(cue::VARCHAR) + 1 + 29 + 1 + length(lines)) + 2 * (count(*) - 1) + 1)::BIGINT AS n_chars, max(b) AS last FROM cues GROUP BY 1)
SELECT video_id, n_chars, CASE n_chars % 5 WHEN 1 THEN 'no_header' WHEN 2 THEN 'no_cues' WHEN 3 THEN CASE WHEN last > 5 THEN 'backward_cue overlap' ELSE 'backward_cue' END WHEN 4 THEN 'bad_time' ELSE '' END AS problems FROM t""",
    "hotspots": f"""WITH {_SEGMENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a, conf DESC, seq) AS r FROM seg WHERE conf >= 0.6e0 AND b - a >= 0.8e0)
SELECT video_id, r::INTEGER AS number, 'pin-' || r || '-' || tag AS hotspot_id, upper(tag[1]) || tag[2:] AS title, a AS start, b AS "end", 'Observed: ' || tag AS description FROM k""",
    "active_at": f"WITH {_SEGMENTS} SELECT video_id, seq, tag, a AS start, b AS \"end\" FROM seg WHERE a - 0.5 <= 43200 AND b + 0.5 >= 43200",
    "vtt_timestamp": """WITH m AS (SELECT event_id, floor(greatest(value * 997, 0) * 1000 + 0.5)::BIGINT AS ms FROM events)
SELECT event_id, lpad((ms // 3600000)::VARCHAR, greatest(2, length((ms // 3600000)::VARCHAR))::INTEGER, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS stamp FROM m""",
    "tag_rules": f"WITH {_HITS} SELECT tag, count(*) AS n, round(sum(confidence), 2) AS confidence FROM hits GROUP BY 1",
    "tag_fusion": f"WITH {_FUSED} SELECT tag, evidence, count(*) AS n, round(sum(confidence), 2) AS confidence FROM fused GROUP BY ALL",
    "tag_conflicts": f"WITH {_FUSED} SELECT DISTINCT o.p_partkey, o.tag, round(o.c, 3) AS external_confidence FROM outside o JOIN local l ON l.p_partkey = o.p_partkey AND l.tag = o.tag WHERE o.c < l.confidence * 0.5e0",
    "number_extract": f"WITH {_FIGURES} SELECT doc_id, len(v)::BIGINT AS n, round(coalesce(list_sum(v), 0), 2) AS total FROM f",
    "grounding_check": """SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN (n_chars + 1)::VARCHAR ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' 0.5' ELSE '' END) AS ungrounded,
  doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS grounded FROM documents""",
    "project_summary": """WITH f AS (SELECT o_orderpriority AS p, left(o_orderpriority, 1)::INTEGER AS r, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS v,
  count(*) FILTER (o_orderstatus = 'P') AS q, count(*) FILTER (o_orderstatus = 'O') AS w FROM orders GROUP BY 1),
s AS (SELECT p, [p || ' has ' || n || ' assets, of which ' || v || ' are verified.',
  CASE WHEN q > 0 THEN q || ' assets are in quarantine and ' || w || ' await review.' END,
  CASE WHEN r <> 2 THEN 'Canopy changed by ' || printf('%+.1f', r * 1.5 - 4) || '%.' END,
  CASE WHEN r >= 3 THEN 'Registration is above the floor with a mean inlier ratio of ' || printf('%.2f', r * 0.2e0) || '.' END,
  CASE WHEN r <> 3 THEN 'Net certified removals are ' || printf('%.1f', r * 10e0) || ' tCO2e.' END,
  'The sampling error is ' || CASE r WHEN 1 THEN '1.3' WHEN 2 THEN '2.3' WHEN 3 THEN '3.3' WHEN 4 THEN '4.3' ELSE '5.3' END || '%.', 'The area is 14.5 ha.'] AS parts FROM f)
SELECT p AS project_name, array_to_string(list_filter(parts, lambda x: x IS NOT NULL)[1:6], ' ') AS summary FROM s""",
    "label_quality": """SELECT 'good' AS kind, lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 2
UNION ALL SELECT 'unlabelled', lang, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2""",
    "ratio_test_knn": """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT) AS v FROM embeddings),
p AS (SELECT q.vec_id AS q, r.vec_id AS o, list_sum([power(q.v[i] - r.v[i], 2) FOR i IN range(1, len(q.v) + 1)])::BIGINT AS d FROM s q JOIN s r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, o) AS r FROM p)
SELECT a.q, a.o AS nearest, a.d AS d1, b.d AS d2, a.d * 16 < b.d * 9 AS kept FROM k a JOIN k b ON a.q = b.q AND a.r = 1 AND b.r = 2""",
    "rate_limit_window": "SELECT user_id, floor(epoch(ts))::BIGINT // 3600 * 60 AS minute, count(*) AS n, count(*) - 1 AS rejected, 60 AS retry_after FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "notification_dedup": f"""WITH {_NOTES}, b AS (SELECT *, coalesce(count(*) FILTER (status = 'ACCEPTED') OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM notes),
s AS (SELECT CASE WHEN status IN ('ACCEPTED', 'IGNORED_UNHANDLED') AND before > 0 THEN 'DUPLICATE' ELSE status END AS status FROM b)
SELECT status, CASE WHEN status = 'REJECTED_UNVERIFIED' THEN 400 ELSE 200 END AS http, count(*) AS n FROM s GROUP BY 1""",
    "freshness": f"WITH {_NOTES} SELECT reason = 'verified' AS ok, reason, count(*) AS n FROM notes GROUP BY 2",
    "handler_counts": f"""WITH {_NOTES} SELECT kind, CASE WHEN kind IN ('eager', 'upload', 'video') THEN 'ACCEPTED' ELSE 'IGNORED_UNHANDLED' END AS status, count(*) AS n,
  count(DISTINCT key) AS keys FROM notes GROUP BY 1""",
    "signatures": "SELECT event_id, sha256(event_id || '|' || props || '1700000000' || 'secret') AS signature FROM events",
    "otsu_threshold": """WITH x AS (SELECT vec_id, unnest(list_transform(embedding, lambda e: floor(greatest(0, least(255, (e::DOUBLE + 1) * 127.5)))::BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
h AS (SELECT vec_id, v, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT vec_id, v, sum(n) OVER up AS w, sum(v * n) OVER up AS s, sum(n) OVER all_of AS wt, sum(v * n) OVER all_of AS st FROM h
  WINDOW up AS (PARTITION BY vec_id ORDER BY v), all_of AS (PARTITION BY vec_id)),
b AS (SELECT vec_id, v, CASE WHEN wt > w THEN power((st * w - s * wt)::DOUBLE, 2) / (w * (wt - w))::DOUBLE ELSE -1 END AS variance FROM c)
SELECT vec_id, CASE WHEN max(variance) < 0 THEN 0 ELSE arg_min(v, (-variance, v)) END AS threshold FROM b GROUP BY 1""",
    "median_gains": """WITH g AS (SELECT o_orderpriority, median(o_totalprice) FILTER (o_orderstatus = 'F') / median(o_totalprice) FILTER (o_orderstatus = 'O') AS gain FROM orders GROUP BY 1)
SELECT o_orderpriority, round(gain, 6) AS gain, CASE WHEN gain > 3 OR gain < 1 / 3e0 THEN 'REFUSED' WHEN abs(gain - 1) <= 0.02e0 THEN 'NOOP' ELSE 'CORRECTED' END AS status FROM g""",
    "histogram_match": """WITH h AS (SELECT l_suppkey, l_returnflag AS f, floor(l_quantity)::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey, f, v, sum(n) OVER (PARTITION BY l_suppkey, f ORDER BY v) AS c, sum(n) OVER (PARTITION BY l_suppkey, f) AS t FROM h)
SELECT a.l_suppkey, a.v, min(b.v) AS matched FROM c a JOIN c b ON a.l_suppkey = b.l_suppkey AND a.f = 'R' AND b.f = 'N' AND b.c * a.t >= a.c * b.t GROUP BY 1, 2""",
    "report_rows": f"""WITH {_ERRORS} SELECT 'SUP-' || lpad(l_suppkey::VARCHAR, 3, '0') AS project_id, NULL::VARCHAR AS problem,
  'https://app.example.org/api/v1/assets/SUP-' || lpad(l_suppkey::VARCHAR, 3, '0') || '/provenance' AS record_url FROM errors""",
    "notification_results": """WITH k AS (SELECT ts, event_type = 'click' AS other, user_id || ':' || CAST(json_extract(props, '$.k') AS BIGINT) AS key FROM events),
b AS (SELECT *, coalesce(count(*) FILTER (NOT other) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT CASE WHEN before > 0 THEN 'DUPLICATE' WHEN other THEN 'IGNORED_UNHANDLED' ELSE 'ACCEPTED' END AS status, count(*) AS n FROM b GROUP BY 1""",
    "affine_residual": "SELECT l_suppkey, round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / count(*)), 2) AS rms FROM lineitem GROUP BY 1",
}
