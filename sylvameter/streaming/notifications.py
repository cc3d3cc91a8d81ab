"""Notifications as a stream: verify, parse, accept once, dispatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvameter.session import ship
from sylvameter.streaming.handlers import handled

#: Seconds for which a signed time is fresh, header names, and handled kinds.
FRESH_SECONDS = 7200
SIGNATURE_HEADERS = ("x-cld-signature", "x-signature")
TIMESTAMP_HEADER = "x-cld-timestamp"
HANDLED = ("eager", "upload", "video")
BODY = "struct<notification_id:string,request_id:string,asset_id:string,public_id:string,version:string,notification_type:string>"
SCHEMA = "body binary, headers map<string,string>, received_at timestamp"


def _header(headers: Column, name: str) -> Column:
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.nullif(F.trim(F.get(found, F.lit(0))["value"]), F.lit(""))


def signature(body: Column, timestamp: Column, secret: str, algorithm: str = "sha1") -> Column:
    """Hex digest of body, timestamp and secret."""
    data = F.concat(body, timestamp.cast("binary"), F.lit(secret).cast("binary"))
    return F.sha1(data) if algorithm == "sha1" else F.sha2(data, 256)


def verified(df: DataFrame, secret: str | None, now: Column | None = None, algorithm: str = "sha1") -> DataFrame:
    """``df`` (SCHEMA) with ok and reason. Staleness, also of times to come, is judged before the signature.

    ``now`` is the time of judgement; by default the time of receipt, so that a replay of the stream judges alike.
    """
    if not secret:
        return df.withColumn("ok", F.lit(True)).withColumn("reason", F.lit("unsigned_allowed"))
    given = F.coalesce(*[_header(F.col("headers"), h) for h in SIGNATURE_HEADERS])
    stamp = _header(F.col("headers"), TIMESTAMP_HEADER)
    seconds = stamp.try_cast("double")
    moment = F.unix_seconds(F.col("received_at") if now is None else now)
    reason = (
        F.when(given.isNull(), "no_signature").when(stamp.isNull(), "no_timestamp").when(seconds.isNull(), "bad_timestamp")
        .when(F.abs(moment - F.floor(seconds)) > FRESH_SECONDS, "stale").when(F.lower(given) != signature(F.col("body"), stamp, secret, algorithm), "mismatch")
        .otherwise("verified")
    )
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "verified")


def parsed(df: DataFrame, with_kind: bool = True) -> DataFrame:
    """``df`` with p (the payload), kind and key; key tells one notification from another.

    The key is the notification's id, or asset, public id and version (and kind, unless ``with_kind`` is off), or a
    digest of the body. A body that is no JSON object has a null payload.
    """
    text = F.col("body").cast("string")
    payload = F.when(F.trim(text).startswith("{"), F.from_json(text, BODY))
    out = df.withColumn("p", payload).withColumn("kind", F.col("p.notification_type"))
    own = F.concat_ws(":", F.col("p.asset_id"), F.col("p.public_id"), F.col("p.version"), *([F.col("kind")] if with_kind else []))
    key = F.coalesce(F.col("p.notification_id"), F.when(F.col("p.public_id").isNotNull() & F.col("p.version").isNotNull(), own), F.substring(F.sha2(F.col("body"), 256), 1, 24))
    return out.withColumn("key", key)


def judged(df: DataFrame, secret: str | None, **settings) -> DataFrame:
    """(key, received_at, kind, status, reason, ready, derived) before duplicates are looked for.

    Status HANDLER_FAILED is that of a payload that its handler cannot take, with the handler's reason; ``derived`` is
    JSON of what the handler made of it, for accepted ones alone.
    """
    rows = parsed(verified(df, secret, **settings)).withColumn("text", F.when(F.col("ok") & F.col("p").isNotNull(), F.col("body").cast("string")))
    rows = handled(rows)
    status = (
        F.when(~F.col("ok"), "REJECTED_UNVERIFIED").when(F.col("p").isNull(), "REJECTED_MALFORMED")
        .when(~F.coalesce(F.col("kind"), F.lit("")).isin(list(HANDLED)), "IGNORED_UNHANDLED").when(F.col("failure").isNotNull(), FAILED).otherwise("ACCEPTED")
    )
    rows = rows.withColumn("status", status)
    ready = F.coalesce(F.get_json_object("derived", "$.ready_count").cast("int"), F.lit(0))
    return rows.select(
        "key", "received_at", "kind", "status", F.when(F.col("status") == FAILED, F.concat(F.lit("handler failed: "), "failure")).otherwise(F.col("reason")).alias("reason"),
        ready.alias("ready"), F.when(F.col("status") == "ACCEPTED", F.col("derived")).alias("derived"),
    )


def http_status(status: Column) -> Column:
    return F.when(status.isin("ACCEPTED", "DUPLICATE", "IGNORED_UNHANDLED"), 200).otherwise(400)


RESULT = "key string, received_at timestamp, kind string, status string, reason string, ready int, derived string"
#: Of a payload that its handler cannot take, until it is known whether it is a duplicate.
FAILED = "HANDLER_FAILED"
#: What is a duplicate if its key was accepted before; of these, only an accepted one counts for later ones.
_REPEATS = ("ACCEPTED", "IGNORED_UNHANDLED", FAILED)


def process(df: DataFrame, secret: str | None, keep_hours: int = 24, **settings) -> DataFrame:
    """One result row for each notification, duplicates of accepted ones told as such; batch or stream.

    State by key says that one was accepted; it ends when the watermark is ``keep_hours`` past the last one. A batch has
    the same result by a window over the key.
    """
    rows = judged(df, secret, **settings)
    if not df.isStreaming:
        from pyspark.sql import Window

        before = F.count_if(F.col("status") == "ACCEPTED").over(Window.partitionBy("key").orderBy("received_at").rowsBetween(Window.unboundedPreceding, -1))
        again = F.col("status").isin(list(_REPEATS)) & (before > 0)
        status = F.when(again, "DUPLICATE").when(F.col("status") == FAILED, "REJECTED_MALFORMED").otherwise(F.col("status"))
        return rows.withColumn("again", again).withColumn("status", status).withColumn("derived", F.when(~F.col("again"), F.col("derived"))).drop("again")

    def once(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.exists, state.getCurrentWatermarkMs()
        for pdf in batches:
            last = max([last, *pdf["at"].dropna().astype(int)])
            pdf = pdf.sort_values("received_at", kind="stable").reset_index(drop=True)
            for i, status in enumerate(pdf["status"]):
                if status in _REPEATS and seen:
                    pdf.loc[i, ["status", "derived"]] = ["DUPLICATE", None]
                elif status == FAILED:
                    pdf.loc[i, "status"] = "REJECTED_MALFORMED"
                seen = seen or status == "ACCEPTED"
            yield pdf[["key", "received_at", "kind", "status", "reason", "ready", "derived"]]
        if seen:
            state.update((True,))
            state.setTimeoutTimestamp(last + keep_hours * 3_600_000)  # the first batch has no watermark yet

    from pyspark.sql.streaming.state import GroupStateTimeout

    ship(df.sparkSession)
    timed = rows.withColumn("at", F.unix_millis("received_at")).withWatermark("received_at", f"{FRESH_SECONDS} seconds")
    return timed.groupBy("key").applyInPandasWithState(once, RESULT, "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)


def accepted_once(df: DataFrame, secret: str | None, **settings) -> DataFrame:
    """Accepted notifications without repeats, for sinks that need no duplicate rows."""
    rows = judged(df, secret, **settings).where("status = 'ACCEPTED'")
    if not df.isStreaming:
        return rows.dropDuplicates(["key"])
    return rows.withWatermark("received_at", f"{FRESH_SECONDS} seconds").dropDuplicatesWithinWatermark(["key"])


def over_limit(df: DataFrame, key: str, ts: str, per_minute: int) -> DataFrame:
    """(key, minute, n, rejected, retry_after) of callers above a limit in a minute; works on streams with a watermark."""
    counts = df.groupBy(F.window(ts, "1 minute").alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > per_minute).select("key", F.col("w.start").alias("minute"), "n", (F.col("n") - per_minute).alias("rejected"), F.lit(60).alias("retry_after"))


def folder_source(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """A durable queue: JSON files of a folder in the order they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def drain(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Take what waits, once, and end; what was taken is not taken again."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
