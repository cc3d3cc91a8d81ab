"""Notifications of every kind through their handlers: by row against the sweep of whole tables, in batch and stream."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sylvameter.operators import intervals
from sylvameter.streaming import handlers, notifications

START = dt.datetime(2026, 1, 1, 12, tzinfo=dt.timezone.utc)


def _video(*items, **more):
    return {"notification_type": "video", "info": {"categorization": {"google_video_tagging": {"data": list(items)}}}} | more


def _item(tag, start, end, confidence=None, long=False):
    names = ("start_time_offset", "end_time_offset") if long else ("start", "end")
    return {"tag": tag, names[0]: start, names[1]: end} | ({} if confidence is None else {"confidence": confidence})


NESTED = [_item("forest", 0, 10, 0.9, True), _item("canopy_cover", "2.0", "6", 0.95), _item("low", 0, 10, 0.2), _item("short", 7, 7.4, 0.7), _item("canopy_cover", 4, 3, "0.7")]
#: Payload, status, and some of what is derived from it (or the reason of a failure).
CASES = [
    ({"notification_type": "eager", "eager": [{"transformation": "c_fill,w_100", "secure_url": "u"}, "w_200", {"secure_url": "x"}], "secure_url": "s"}, "ACCEPTED", {"ready_count": 3, "ready_transformations": ["c_fill,w_100", "w_200", None], "secure_url": "s"}),
    ({"notification_type": "eager", "eager": []}, "ACCEPTED", {"ready_count": 0}),
    ({"notification_type": "eager"}, "ACCEPTED", {"ready_count": 0}),
    ({"notification_type": "eager", "eager": 7}, "REJECTED_MALFORMED", "eager is no list"),
    ({"notification_type": "upload", "format": "jpg", "bytes": 123456789012, "secure_url": "https://x/y"}, "ACCEPTED", {"resource_type": "image", "format": "jpg", "bytes": 123456789012, "secure_url": "https://x/y"}),
    ({"notification_type": "upload", "resource_type": "video"}, "ACCEPTED", {"resource_type": "video", "format": "", "bytes": 0}),
    (_video(*NESTED), "ACCEPTED", {"segment_count": 4, "tags": ["canopy_cover", "forest", "short"]}),
    (_video(), "ACCEPTED", {"segment_count": 0, "tags": []}),
    ({"notification_type": "video"}, "ACCEPTED", {"segment_count": 0}),
    (_video(5, "x", None, {"tag": None, "start": 1, "end": 2}, {"tag": "a", "start": "soon", "end": 2}, {"tag": "a"}), "ACCEPTED", {"segment_count": 0}),
    (_video(_item("alone", 1, 3)), "ACCEPTED", {"segment_count": 1}),
    (_video(_item("short", 1, 1.5)), "REJECTED_MALFORMED", "no segment is long enough for a cue"),
    (_video(_item("a --> b", 1, 5)), "REJECTED_MALFORMED", "a tag contains a cue arrow"),
    ({"notification_type": "video", "info": "none"}, "REJECTED_MALFORMED", "tags are not in objects"),
    ({"notification_type": "video", "info": {"categorization": {"google_video_tagging": {"data": "x"}}}}, "ACCEPTED", {"segment_count": 0}),
    ({"notification_type": "context"}, "IGNORED_UNHANDLED", None),
    ([1, 2], "REJECTED_MALFORMED", None),
]


def _rows():
    rows = []
    for i, (payload, *_) in enumerate(CASES):
        body = json.dumps(payload | {"notification_id": f"n{i}"} if isinstance(payload, dict) else payload).encode()
        rows.append((body, {}, START + dt.timedelta(seconds=i)))
    return rows


def test_handlers(spark):
    got = notifications.process(spark.createDataFrame(_rows(), notifications.SCHEMA), None).orderBy("received_at").collect()
    for r, (payload, status, wanted) in zip(got, CASES, strict=True):
        assert r.status == status, payload
        derived = json.loads(r.derived) if r.derived else {}
        if isinstance(wanted, dict):
            assert {k: derived.get(k) for k in wanted} == wanted and r.ready == derived.get("ready_count", 0)
        else:
            assert r.derived is None and (wanted is None or r.reason == f"handler failed: {wanted}")


def test_track_and_pins_of_a_row_are_those_of_the_tables(spark):
    payload = json.dumps(_video(*NESTED))
    row = handlers.handled(spark.createDataFrame([(payload, "video")], "text string, kind string")).first()
    derived = json.loads(row.derived)
    segments = intervals.segments_from_json(spark.createDataFrame([("v", payload)], "video_id string, payload string"))
    cues = intervals.cues(segments)
    assert derived["vtt"] == intervals.caption_documents(cues).first().vtt
    assert "1\n00:00:00.000 --> 00:00:02.000\nforest\n\n2\n00:00:02.000 --> 00:00:03.000\ncanopy_cover\nforest\n" in derived["vtt"]
    pins = intervals.hotspots(segments).orderBy("number").collect()
    assert [(p["hotspot_id"], p["title"], p["start"], p["end"]) for p in derived["hotspots"]] == [(p.hotspot_id, p.title, p.start, p.end) for p in pins]
    assert spark.range(1).select(intervals.caption_problems(F.lit(derived["vtt"]))).first()[0] == []


def test_failed_payload_leaves_its_key_free(spark):
    bad, good = ({"notification_type": "eager", "notification_id": "k", "eager": e} for e in (3, ["x"]))
    rows = [(json.dumps(p).encode(), {}, START + dt.timedelta(seconds=i)) for i, p in enumerate((bad, good, bad, good))]
    got = notifications.process(spark.createDataFrame(rows, notifications.SCHEMA), None).orderBy("received_at").collect()
    assert [r.status for r in got] == ["REJECTED_MALFORMED", "ACCEPTED", "DUPLICATE", "DUPLICATE"]
    assert [r.derived is None for r in got] == [True, False, True, True]


def test_stream_equals_batch(spark, tmp_path):
    source, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    rows = _rows() + [(b, h, t + dt.timedelta(minutes=1)) for b, h, t in _rows()[:7]]
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame(part, notifications.SCHEMA).coalesce(1).write.mode("append").json(source)
        notifications.drain(notifications.process(notifications.folder_source(spark, source, files_per_batch=1), None), check, out)
    columns = ("received_at", "key", "status", "reason", "ready", "derived")
    key = lambda df: sorted(tuple(r[c] or "" if c == "derived" else r[c] for c in columns) for r in df.select(*columns).collect())
    assert key(spark.read.parquet(out)) == key(notifications.process(spark.createDataFrame(rows, notifications.SCHEMA), None))
