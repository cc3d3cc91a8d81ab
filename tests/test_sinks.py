"""The metadata sink: what is written, what is turned away, and what a restart leaves."""

import json
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sylvameter.sources import corpus, sinks
from sylvameter.sources.sinks import MetadataSink


@pytest.fixture(scope="module")
def assets(spark):
    return sinks.payload(corpus.assets(spark, per_project=6)).cache()


def test_payload_rounds_as_it_should(spark):
    rows = [("a", 84.99, 2.5), ("b", -1.5, 3.5), ("c", None, None), ("d", 0.0, -0.5)]
    got = sinks.payload(spark.createDataFrame(rows, "public_id string, sift_inlier_ratio double, canopy_delta_pct double")).collect()
    assert [tuple(r) for r in got] == [("a", 84, 2), ("b", -1, 4), ("c", None, None), ("d", 0, 0)]


def test_batches_are_written_once(spark, assets, tmp_path):
    sink = MetadataSink(spark, str(tmp_path / "sink"))
    bad = assets.limit(2).withColumn("public_id", F.lit("../up")).withColumn("canopy_delta_pct", F.lit(900))
    sink.write(assets.unionByName(bad), 0)
    sink.write(assets.limit(0), 1)
    sink.write(assets.limit(3), 0)  # a repeat, of whatever content
    assert [(r.batch, r.n_written, r.n_rejected) for r in sink.log().orderBy("batch").collect()] == [(0, 24, 2), (1, 0, 0)]
    assert sink.rows().count() == 24 and {tuple(r.problems) for r in sink.rejected().collect()} == {("public_id:unsafe", "canopy_delta_pct:too_high")}
    later = assets.limit(1).withColumn("jev_confidence_score", F.lit(7))
    sink.write(later, 2)
    assert sink.rows().count() == 25 and sink.latest().count() == 24 and sink.latest().where("jev_confidence_score = 7").count() == 1


def test_stub_names_the_fields(spark, assets):
    rows = sinks.stubbed(assets.unionByName(assets.limit(1).withColumn("milestone_phase", F.lit("later")))).collect()
    good, bad = [r for r in rows if r.status == "STUBBED"], [r for r in rows if r.status == "REJECTED"]
    assert len(good) == 24 and all(r.fields_written == sorted(r.fields_written) and "milestone_phase" in r.fields_written for r in good)
    assert [(r.fields_written, r.problems) for r in bad] == [(None, ["milestone_phase:not_allowed"])]


@pytest.mark.parametrize("fails_in", ["rows", "log"])
def test_stream_that_fails_and_starts_again(spark, assets, tmp_path, monkeypatch, fails_in):
    """The second batch fails before or after its rows are written; the restart ends with every row once."""
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for part in range(3):
        assets.where(F.abs(F.xxhash64("public_id")) % 3 == part).coalesce(1).write.mode("append").json(source)
    sink = MetadataSink(spark, str(tmp_path / "sink"))
    stream = lambda: spark.readStream.schema(assets.schema).option("maxFilesPerTrigger", 1).json(source)
    whole, calls = MetadataSink._path, []

    def breaks(self, name, batch):
        if name == fails_in and batch == 1 and not calls:
            if fails_in == "rows" or (Path(self.folder) / "rows" / "batch=1").exists():
                calls.append(batch)
                raise OSError("the store is away")
        return whole(self, name, batch)

    monkeypatch.setattr(MetadataSink, "_path", breaks)
    with pytest.raises(StreamingQueryException):
        sink.stream(stream(), check).awaitTermination()
    assert [r.batch for r in sink.log().collect()] == [0]
    if fails_in == "log":  # what the failed batch left behind does not count
        assert sink.rows().select("batch").distinct().collect() == [(0,)] and (Path(sink.folder) / "rows" / "batch=1").exists()
    sink.stream(stream(), check).awaitTermination()
    sink.stream(stream(), check).awaitTermination()
    assert sorted(r.batch for r in sink.log().collect()) == [0, 1, 2]
    assert sorted(r.public_id for r in sink.rows().collect()) == sorted(r.public_id for r in assets.collect())


def test_manifest_says_what_made_it(spark, tmp_path):
    corpus.write_manifest(corpus.assets(spark, per_project=3), str(tmp_path), per_project=3)
    meta = [json.loads(x) for p in (tmp_path / "meta").glob("*.json") for x in p.read_text().splitlines()]
    assert len(meta) == 1 and meta[0]["per_project"] == 3 and meta[0]["seed"] == 20260922 and meta[0]["deterministic"] and len(meta[0]["schema_version"]) == 16
    assert meta[0]["projects"] == sorted(p[0] for p in corpus.PROJECTS)
    assert spark.read.json(f"{tmp_path}/assets").count() == 12 and spark.read.json(f"{tmp_path}/summary").first().total == 12
