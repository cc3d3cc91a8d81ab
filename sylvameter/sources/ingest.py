"""Bulk ingest of image files: fifty to a batch, measured as they come, and whatever cannot be taken put aside with a reason.

A stream of Spark's ``binaryFile`` source takes the files of a folder in batches. The header of each file tells format
and size before anything is decoded, so a file that would unfold to more pixels than the bound is never opened. The files
of a batch that pass are decoded by Spark's image source and measured. Results and rejects are written under the number of
the batch: a stream that starts again after a failure writes over what that batch left behind, and takes nothing twice.
Spark's file sources pass over files of no bytes at all, so these are in neither table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylvameter.operators.measure import BATCH_FILES, MOST_PIXELS, from_image_source, measure_images
from sylvameter.session import ship

_FILES = "path string, modificationTime timestamp, length long, content binary"
_JUDGED = "path string, length long, format string, width long, height long, error string"
#: Markers of a JPEG frame, whose segment has the size.
_FRAMES = frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})


def header(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the first bytes of a PNG, GIF, BMP or JPEG file; None for all else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "bmp", abs(width), abs(height)
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            if data[at + 1] in _FRAMES:
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height
            at += 1 if data[at + 1] == 0xFF else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def judged_files(files: DataFrame, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """(path, length, format, width, height, error) of ``files`` (path, length, content); error is null where all is well."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length, data in zip(pdf["path"], pdf["length"], pdf["content"], strict=True):
                found = header(data) if data else None
                error = "empty file" if not data else "no image of a known format" if found is None else None
                if found and found[1] * found[2] > most_pixels:
                    error = "too many pixels"
                elif found and not found[1] * found[2]:
                    error = "no pixels"
                rows.append((path, length, *(found or (None, None, None)), error))
            out = pd.DataFrame(rows, columns=["path", "length", "format", "width", "height", "error"], dtype=object)
            yield out

    ship(files.sparkSession)
    return files.select("path", "length", "content").mapInPandas(judge, _JUDGED)


class ImageIngest:
    """Measured images and rejects under ``folder``: ``ingested`` (as ``measure_images``) and ``quarantine`` by batch."""

    def __init__(self, spark: SparkSession, folder: str, most_pixels: int = MOST_PIXELS) -> None:
        self.spark, self.folder, self.most_pixels = spark, folder, most_pixels

    def write(self, files: DataFrame, batch: int) -> None:
        """Take in the files of one batch; what is brought to the driver are their names, of which a batch has few."""
        judged = judged_files(files, self.most_pixels).drop("length").distinct().collect()  # a stream may list odd names twice
        good = [r.path for r in judged if r.error is None]
        bad = self.spark.createDataFrame([(r.path, r.error) for r in judged if r.error], "image_id string, error string")
        if good:
            images = self.spark.read.format("image").option("dropInvalid", False).load([_escaped(p) for p in good])
            measured = measure_images(from_image_source(images)).withColumn("image_id", _plain(F.col("image_id"))).persist()
            sound = F.col("status") == "INGESTED"
            bad = bad.unionByName(measured.where(~sound).select("image_id", "error"))
            measured.where(sound).write.mode("overwrite").parquet(f"{self.folder}/ingested/batch={batch}")
            bad.write.mode("overwrite").parquet(f"{self.folder}/quarantine/batch={batch}")
            measured.unpersist()
        else:
            bad.write.mode("overwrite").parquet(f"{self.folder}/quarantine/batch={batch}")

    def stream(self, source: str, checkpoint: str, batch_files: int = BATCH_FILES) -> StreamingQuery:
        """Take what is in the folder ``source`` and not taken yet, ``batch_files`` files at a time, and end."""
        files = self.spark.readStream.schema(_FILES).format("binaryFile").option("maxFilesPerTrigger", batch_files).load(source)
        return files.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def ingested(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/ingested").parquet(f"{self.folder}/ingested")

    def quarantine(self) -> DataFrame:
        """(image_id, error, batch) of the files that were not taken."""
        return self.spark.read.option("basePath", f"{self.folder}/quarantine").parquet(f"{self.folder}/quarantine")


def _plain(origin: Column) -> Column:
    """The name of a file as ``binaryFile`` has it; the image source writes it as an address."""
    return F.regexp_replace(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def _escaped(path: str) -> str:
    """A path as a pattern that it alone matches."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)
