import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from sylvameter.streaming import notifications

SECRET = "s3cret"
START = dt.datetime(2026, 1, 1, 12, tzinfo=dt.timezone.utc)


def _rows():
    """(body, headers, received_at) with the status that each should have."""
    def signed(body: bytes, at: dt.datetime, stamp: str | None = None, secret: str = SECRET):
        stamp = stamp or str(int(at.timestamp()))
        return {"X-Cld-Signature": hashlib.sha1(body + stamp.encode() + secret.encode()).hexdigest(), "X-Cld-Timestamp": stamp}

    body = lambda n, kind="upload": json.dumps({"notification_id": n, "notification_type": kind}).encode()
    at = [START + dt.timedelta(seconds=i) for i in range(12)]
    old = str(int(START.timestamp()) - 8000)
    return [
        (body("a"), signed(body("a"), at[0]), at[0], "ACCEPTED"), (body("a"), signed(body("a"), at[1]), at[1], "DUPLICATE"), (body("b"), signed(body("b"), at[2], secret="x"), at[2], "REJECTED_UNVERIFIED"),
        (body("b"), signed(body("b"), at[3]), at[3], "ACCEPTED"), (body("c"), {}, at[4], "REJECTED_UNVERIFIED"), (body("d"), signed(body("d"), at[5], old), at[5], "REJECTED_UNVERIFIED"),
        (b"[1]", signed(b"[1]", at[6]), at[6], "REJECTED_MALFORMED"), (body("e", "other"), signed(body("e", "other"), at[7]), at[7], "IGNORED_UNHANDLED"),
        (body("e"), signed(body("e"), at[8]), at[8], "ACCEPTED"), (body("f"), signed(body("f"), at[9], "soon"), at[9], "REJECTED_UNVERIFIED"), (body("g") + b" ", signed(body("g"), at[10]), at[10], "REJECTED_UNVERIFIED"),
    ]


def test_batch(spark):
    rows = _rows()
    df = spark.createDataFrame([r[:3] for r in rows], notifications.SCHEMA)
    got = notifications.process(df, SECRET).orderBy("received_at").collect()
    assert [r.status for r in got] == [r[3] for r in rows]
    reasons = [r.reason for r in got]
    assert reasons[2] == "mismatch" and reasons[4] == "no_signature" and reasons[5] == "stale" and reasons[9] == "bad_timestamp"
    assert [r[0] for r in notifications.process(df, SECRET).orderBy("received_at").select(notifications.http_status(F.col("status"))).collect()][:3] == [200, 200, 400]
    assert notifications.process(df, None).where("status like 'REJECTED_UNV%'").count() == 0
    assert notifications.accepted_once(df, SECRET).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = _rows()
    source, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    for part in (rows[:5], rows[5:]):  # two drains of one queue
        spark.createDataFrame([r[:3] for r in part], notifications.SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = notifications.folder_source(spark, source, files_per_batch=1)
        notifications.drain(notifications.process(stream, SECRET), check, out)
    key = lambda df: sorted((r.received_at, r.key, r.status) for r in df.select("received_at", "key", "status").collect())
    assert key(spark.read.parquet(out)) == key(notifications.process(spark.createDataFrame([r[:3] for r in rows], notifications.SCHEMA), SECRET))


def test_rate_limit(spark):
    at = [(("u" if i < 5 else "v"), START + dt.timedelta(seconds=i * 9)) for i in range(9)]
    got = notifications.over_limit(spark.createDataFrame(at, "who string, ts timestamp"), "who", "ts", 3).collect()
    assert [(r.key, r.n, r.rejected, r.retry_after) for r in got] == [("u", 5, 2, 60)]
