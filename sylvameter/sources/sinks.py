"""Sinks of structured metadata: validated rows, written once for each batch, in batch and in streams.

A batch is a folder of its own by the number that the stream gives it, with an entry in the log of batches written last.
What a batch left behind that failed is written over when it is repeated; a batch with an entry is left alone. So a stream
that starts again from its checkpoint writes nothing twice and loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylvameter.operators.validation import METADATA, Rule, safe_public_id, validate
from sylvameter.session import exists

#: Fixed value: the fields that a push sends where they are not null.
PUSHED = (
    "esg_project_id", "sustainability_domain", "cadastral_polygon_id", "capture_timestamp", "solar_azimuth_error", "jev_triage_decision",
    "jev_confidence_score", "c2pa_provenance", "milestone_phase", "sift_inlier_ratio", "canopy_delta_pct",
)
_LOG = "batch long, n_written long, n_rejected long"


def payload(df: DataFrame) -> DataFrame:
    """public_id and the pushed fields: inlier ratios are cut to whole numbers, canopy changes rounded half to even."""
    whole = {"sift_inlier_ratio": F.col("sift_inlier_ratio").cast("int"), "canopy_delta_pct": F.bround("canopy_delta_pct", 0).cast("int")}
    return df.select("public_id", *[whole.get(c, F.col(c)).alias(c) for c in PUSHED if c in df.columns])


def judged(df: DataFrame, rules: Sequence[Rule] = METADATA) -> DataFrame:
    """``df`` with problems (that of the id first) and fields: the names of what would be written, sorted."""
    bad_id = F.when(~F.coalesce(safe_public_id(F.col("public_id")), F.lit(False)), "public_id:unsafe")
    found = validate(df, rules).drop("first_problem")
    names = [c for c in df.columns if c != "public_id"]
    fields = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])))
    return found.withColumn("problems", F.concat(F.array_compact(F.array(bad_id)), "problems")).withColumn("fields", fields)


def stubbed(df: DataFrame, rules: Sequence[Rule] = METADATA) -> DataFrame:
    """What a sink without an account answers: (public_id, status, fields_written, problems), and nothing is written."""
    rows = judged(df, rules)
    sound = F.size("problems") == 0
    return rows.select("public_id", F.when(sound, "STUBBED").otherwise("REJECTED").alias("status"), F.when(sound, F.col("fields")).alias("fields_written"), "problems")


class MetadataSink:
    """Metadata rows under ``folder``: ``rows`` and ``rejected`` by batch, and the log of batches."""

    def __init__(self, spark: SparkSession, folder: str, rules: Sequence[Rule] = METADATA) -> None:
        self.spark, self.folder, self.rules = spark, folder, rules

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def done(self, batch: int) -> bool:
        return exists(self.spark, self._path("log", batch) + "/_SUCCESS")

    def write(self, df: DataFrame, batch: int) -> None:
        """Take in ``df`` (public_id and fields) as ``batch``; what is unsound goes to ``rejected`` with its problems."""
        if self.done(batch):
            return
        rows = judged(df, self.rules).persist()
        try:
            sound = F.size("problems") == 0
            rows.where(sound).drop("problems", "fields").write.mode("overwrite").parquet(self._path("rows", batch))
            rows.where(~sound).drop("fields").write.mode("overwrite").parquet(self._path("rejected", batch))
            n = rows.agg(F.count_if(sound).alias("n_written"), F.count_if(~sound).alias("n_rejected"))
            n.coalesce(1).write.mode("overwrite").parquet(self._path("log", batch))
        finally:
            rows.unpersist()

    def stream(self, df: DataFrame, checkpoint: str) -> StreamingQuery:
        """The batches of a stream, as they come until it is empty; start it again with the same checkpoint to go on."""
        return df.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def log(self) -> DataFrame:
        """(batch, n_written, n_rejected) of the batches that count."""
        return self.spark.read.option("basePath", f"{self.folder}/log").parquet(f"{self.folder}/log").select(*[F.col(c.split()[0]).cast("long") for c in _LOG.split(", ")])

    def _counted(self, name: str) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").option("mergeSchema", True).parquet(f"{self.folder}/{name}")
        return rows.withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(self.log().select("batch")), "batch", "left_semi")

    def rows(self) -> DataFrame:
        """All rows that were written; leftovers of a batch that failed do not count."""
        return self._counted("rows")

    def rejected(self) -> DataFrame:
        return self._counted("rejected")

    def latest(self) -> DataFrame:
        """The last row of each asset, by batch: what a store that is written over holds."""
        fields = [c for c in self.rows().columns if c not in ("public_id", "batch")]
        last: Column = F.max_by(F.struct(*fields), F.struct("batch", F.xxhash64(*fields)))
        return self.rows().groupBy("public_id").agg(last.alias("r")).select("public_id", "r.*")
