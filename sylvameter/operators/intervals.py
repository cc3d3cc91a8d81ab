"""Interval sweeps: captions and hotspots from overlapping tag intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvameter.functions.text import caption_time, cue_text, parse_caption_time, slug, title

#: Least confidence, least length of a cue in seconds, longest cue, slack of a hotspot.
CONFIDENCE, SHORTEST, LONGEST, SLACK = 0.6, 0.8, 60.0, 0.5
#: Fixed value: where a video result has its tags.
TAGS_PATH = ("info", "categorization", "google_video_tagging", "data")


def is_object(json: Column) -> Column:
    return F.trim(json).startswith("{")


def tagged_segments(payload: Column, confidence: float = CONFIDENCE) -> Column:
    """array<struct<start, rank, seq, tag, end, confidence>> of a video result (JSON), by start and falling confidence.

    Either name of a time is read, as a number or its text; a window that is inverted is turned. Items that are no
    objects, or without a tag or times, go, and so do those below ``confidence``, which is 1 where it is missing.
    """
    path = "$." + ".".join(TAGS_PATH)
    items = F.from_json(F.get_json_object(payload, path), "array<string>")
    fields = F.transform(F.filter(items, is_object), lambda x: F.from_json(x, "map<string,string>"))

    def moment(item: Column, long: str, short: str) -> Column:
        return F.when(F.map_contains_key(item, long), item[long]).otherwise(item[short]).try_cast("double")

    def segment(item: Column, seq: Column) -> Column:
        a, b = moment(item, "start_time_offset", "start"), moment(item, "end_time_offset", "end")
        sure = F.coalesce(item["confidence"].try_cast("double"), F.lit(1.0))
        ends = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
        return F.struct(
            F.least(a, b).alias("start"), (-sure).alias("rank"), seq.alias("seq"), item["tag"].alias("tag"), ends.alias("end"), sure.alias("confidence"),
        )

    whole = F.filter(F.transform(fields, segment), lambda s: s["tag"].isNotNull() & s["end"].isNotNull() & (s["confidence"] >= confidence))
    return F.coalesce(F.array_sort(whole), F.array().cast("array<struct<start:double,rank:double,seq:int,tag:string,end:double,confidence:double>>"))


def segments_from_json(df: DataFrame, payload: str = "payload", confidence: float = CONFIDENCE) -> DataFrame:
    """(video_id, seq, tag, start, end, confidence) of video results, as ``tagged_segments`` reads them."""
    rows = df.select("video_id", F.inline(tagged_segments(F.col(payload), confidence)))
    return rows.select("video_id", "seq", "tag", "start", "end", "confidence")


def windows(segments: DataFrame, shortest: float = SHORTEST) -> DataFrame:
    """(video_id, w_start, w_end): the intervals between edges that follow each other, short ones left out."""
    edges = segments.select("video_id", F.explode(F.array("start", "end")).alias("w_start")).distinct()
    after = F.lead("w_start").over(Window.partitionBy("video_id").orderBy("w_start"))
    return edges.withColumn("w_end", after).where(F.col("w_end") - F.col("w_start") >= shortest)


def cues(
    segments: DataFrame, shortest: float = SHORTEST, confidence: float = CONFIDENCE, most_lines: int | None = None, most_cues: int | None = None
) -> DataFrame:
    """(video_id, cue, start, end, lines): what is seen in each window, surest first, each line once.

    ``most_cues`` keeps the first cues of a video in time, ``most_lines`` the surest lines of a cue. Segments below the confidence still cut the time line. The join is by video; within it, by containment.
    """
    sure = segments.where(F.col("confidence") >= confidence)
    joined = windows(segments, shortest).join(sure, "video_id").where((F.col("start") <= F.col("w_start")) & (F.col("end") >= F.col("w_end")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "seq", cue_text(F.col("tag")).alias("line"))))
    found = joined.groupBy("video_id", "w_start", "w_end").agg(F.array_distinct(F.transform(order, lambda x: x["line"])).alias("lines"))
    if most_lines is not None:
        found = found.withColumn("lines", F.slice("lines", 1, most_lines))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("w_start"))
    numbered = found.select(
        "video_id", number.alias("cue"), F.col("w_start").alias("start"), F.least("w_end", F.col("w_start") + LONGEST).alias("end"), "lines"
    )
    return numbered if most_cues is None else numbered.where(F.col("cue") <= most_cues)


def caption_documents(found: DataFrame, kind: str = "captions") -> DataFrame:
    """(video_id, vtt): cues as one WebVTT document for each video."""
    block = F.concat_ws(
        "\n", F.col("cue").cast("string"), F.concat_ws(" --> ", caption_time(F.col("start")), caption_time(F.col("end"))), F.array_join("lines", "\n")
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", block.alias("b")))), lambda x: x["b"]), "\n\n")
    head = "WEBVTT\n\n" if kind == "captions" else f"WEBVTT\n\nNOTE kind: {kind}\n\n"
    return found.groupBy("video_id").agg(F.concat(F.lit(head), body, F.lit("\n")).alias("vtt"))


def caption_problems(vtt: Column, expected: Column | int | None = None) -> Column:
    """What is wrong with a WebVTT document, as an array of names; empty if nothing is."""
    lines = F.split(F.coalesce(vtt, F.lit("")), "\n", -1)
    timing = F.filter(lines, lambda x: x.contains("-->"))
    times = F.transform(timing, lambda x: F.transform(F.split(x, " --> "), lambda t: parse_caption_time(F.trim(t))))
    wanted = F.lit(None).cast("int") if expected is None else expected if isinstance(expected, Column) else F.lit(expected)
    bad = F.exists(times, lambda t: (F.size(t) != 2) | F.get(t, F.lit(0)).isNull() | F.get(t, F.lit(1)).isNull())
    backward = F.exists(times, lambda t: F.coalesce(F.get(t, F.lit(1)) <= F.get(t, F.lit(0)), F.lit(False)))
    pairs = F.zip_with(times, F.slice(times, 2, F.greatest(F.size(times), F.lit(1))), lambda a, b: F.coalesce(F.get(b, F.lit(0)) < F.get(a, F.lit(1)), F.lit(False)))
    return F.array_compact(
        F.array(
            F.when(F.get(lines, F.lit(0)) != "WEBVTT", "no_header"), F.when(F.size(timing) == 0, "no_cues"), F.when(bad, "bad_time"),
            F.when(backward, "backward_cue"), F.when(F.exists(pairs, lambda x: x), "overlap"), F.when(F.size(timing) != wanted, "cue_count"),
        )
    )


def hotspots(segments: DataFrame, labels: DataFrame | None = None, x: float = 50.0, y: float = 50.0) -> DataFrame:
    """Player pins, numbered by start and falling confidence; ``labels`` (tag, title, description) may name them."""
    kept = segments.where((F.col("confidence") >= CONFIDENCE) & (F.col("end") - F.col("start") >= SHORTEST))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("start", F.desc("confidence"), "seq"))
    rows = kept.withColumn("number", number)
    names = (F.lit(None).cast("string"), F.lit(None).cast("string"))
    if labels is not None:
        rows = rows.join(labels.select("tag", F.col("title").alias("l_title"), F.col("description").alias("l_text")), "tag", "left")
        names = (F.col("l_title"), F.col("l_text"))
    return rows.select(
        "video_id", "number", F.concat(F.lit("pin-"), F.col("number"), F.lit("-"), slug(F.col("tag"))).alias("hotspot_id"),
        F.coalesce(names[0], title(F.col("tag"))).alias("title"), F.greatest("start", F.lit(0.0)).alias("start"), "end",
        F.lit(x).alias("x_pct"), F.lit(y).alias("y_pct"), F.coalesce(names[1], F.concat(F.lit("Observed: "), F.col("tag"))).alias("description"),
        F.create_map(F.lit("confidence"), F.col("confidence")).alias("telemetry"),
    )


def active_at(rows: DataFrame, moment: float, slack: float = 0.0) -> DataFrame:
    """Rows whose interval holds a moment, in order of their start."""
    return rows.where((F.col("start") - slack <= moment) & (F.col("end") + slack >= moment)).orderBy("start")


def tags_by_video(segments: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(video_id, tags): the distinct tags of sure segments, in order; a video without one has an empty array."""
    sure = F.when(F.col("confidence") >= confidence, F.col("tag"))
    return segments.groupBy("video_id").agg(F.array_sort(F.collect_set(sure)).alias("tags"))
