"""What notifications of each kind lead to, as columns of the row itself: no state and no exchange, in batch and stream.

Video results carry their tags as nested JSON. Segments, the caption track and the hotspots of one video are worked out
on arrays inside the row, so that a stream needs no aggregation for them. A payload that a handler cannot take yields a
reason and nothing else; no payload fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.functions.text import caption_time, cue_text, slug, title
from sylvameter.operators.intervals import LONGEST, SHORTEST, TAGS_PATH, caption_problems, is_object, tagged_segments

def segment_cues(segments: Column, shortest: float = SHORTEST) -> Column:
    """array<struct<start, end, lines>>: what is seen between edges that follow each other, surest first, each line once."""
    edges = F.array_sort(F.array_distinct(F.concat(F.transform(segments, lambda s: s["start"]), F.transform(segments, lambda s: s["end"]))))
    after = F.concat(F.slice(edges, 2, F.greatest(F.size(edges), F.lit(1))), F.array(F.lit(None).cast("double")))
    windows = F.filter(F.zip_with(edges, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda w: w["b"] - w["a"] >= shortest)

    def cue(w: Column) -> Column:
        seen = F.filter(segments, lambda s: (s["start"] <= w["a"]) & (s["end"] >= w["b"]))
        ranked = F.array_sort(F.transform(seen, lambda s: F.struct(s["rank"].alias("r"), s["start"].alias("a"), s["seq"].alias("i"), cue_text(s["tag"]).alias("line"))))
        return F.struct(w["a"].alias("start"), F.least(w["b"], w["a"] + LONGEST).alias("end"), F.array_distinct(F.transform(ranked, lambda x: x["line"])).alias("lines"))

    return F.filter(F.transform(windows, cue), lambda c: F.size(c["lines"]) > 0)


def caption_track(cues: Column) -> Column:
    """The cues as one WebVTT document."""
    blocks = F.transform(
        cues,
        lambda c, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat_ws(" --> ", caption_time(c["start"]), caption_time(c["end"])), F.array_join(c["lines"], "\n")),
    )
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n"))


def segment_hotspots(segments: Column, shortest: float = SHORTEST, x: float = 50.0, y: float = 50.0) -> Column:
    """array<struct>: a player pin for each segment that is long enough."""
    kept = F.filter(segments, lambda s: s["end"] - s["start"] >= shortest)
    return F.transform(
        kept,
        lambda s, i: F.struct(
            F.concat(F.lit("pin-"), (i + 1).cast("string"), F.lit("-"), slug(s["tag"])).alias("hotspot_id"), title(s["tag"]).alias("title"),
            F.greatest(s["start"], F.lit(0.0)).alias("start"), s["end"].alias("end"), F.lit(x).alias("x_pct"), F.lit(y).alias("y_pct"),
            F.concat(F.lit("Observed: "), s["tag"]).alias("description"), s["confidence"].alias("confidence"),
        ),
    )


def handled(rows: DataFrame, text: str = "text", kind: str = "kind") -> DataFrame:
    """``rows`` with ``derived`` (JSON of what the handler of ``kind`` makes of the payload ``text``) and ``failure``.

    eager: ready_count, ready_transformations and secure_url; upload: resource_type, format, bytes and secure_url; video:
    segment_count and tags and, if there are segments, the caption track vtt and the hotspots. ``failure`` is why a
    handler cannot take a payload, and null otherwise; with it, and for other kinds, ``derived`` is null.
    """
    payload = F.col(text)

    def field(name: str, otherwise: str = "") -> Column:
        return F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit(otherwise))

    eager = F.get_json_object(payload, "$.eager")
    listed = eager.isNull() | F.trim(eager).startswith("[")
    ready = F.coalesce(F.from_json(F.when(listed, eager), "array<string>"), F.array().cast("array<string>"))
    above = [F.get_json_object(payload, "$." + ".".join(TAGS_PATH[:n])) for n in (1, 2, 3)]
    flat = F.greatest(*[(a.isNotNull() & ~is_object(a)).cast("int") for a in above]) == 1  # no object where tags are looked for
    out = rows.withColumns({"__ready": ready, "__segments": tagged_segments(payload), "__kind": F.col(kind)})
    out = out.withColumn("__cues", F.when(F.col("__kind") == "video", segment_cues(F.col("__segments"))))
    out = out.withColumn("__vtt", F.when(F.size("__cues") > 0, caption_track(F.col("__cues"))))
    seen, cues = F.col("__segments"), F.col("__cues")
    failure = F.when((F.col("__kind") == "eager") & ~listed, "eager is no list").when(
        F.col("__kind") == "video",
        F.when(flat, "tags are not in objects")
        .when((F.size(seen) > 0) & (F.size(cues) == 0), "no segment is long enough for a cue")
        .when(F.exists(cues, lambda c: F.exists(c["lines"], lambda x: x.isNull())), "a tag contains a cue arrow")
        .when((F.size(seen) > 0) & (F.size(caption_problems(F.col("__vtt"), F.size(cues))) > 0), "the caption track is not valid"),
    )
    results = {
        "eager": F.struct(
            F.size("__ready").alias("ready_count"),
            F.transform("__ready", lambda x: F.when(is_object(x), F.get_json_object(x, "$.transformation")).otherwise(x)).alias("ready_transformations"),
            field("secure_url").alias("secure_url"),
        ),
        "upload": F.struct(
            field("resource_type", "image").alias("resource_type"), field("format").alias("format"),
            F.coalesce(F.get_json_object(payload, "$.bytes").try_cast("long"), F.lit(0).cast("long")).alias("bytes"), field("secure_url").alias("secure_url"),
        ),
        "video": F.struct(
            F.size(seen).alias("segment_count"), F.array_sort(F.array_distinct(F.transform(seen, lambda s: s["tag"]))).alias("tags"),
            F.col("__vtt").alias("vtt"), F.when(F.size(seen) > 0, segment_hotspots(seen)).alias("hotspots"),
        ),
    }
    derived = F.coalesce(*[F.when(F.col("__kind") == k, F.to_json(v)) for k, v in results.items()])
    whole = out.withColumn("failure", failure).withColumn("derived", F.when(F.col("failure").isNull(), derived))
    return whole.drop("__ready", "__segments", "__kind", "__cues", "__vtt")
