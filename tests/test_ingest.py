"""Ingest of image files: sound ones measured, all others put aside, and a batch that fails taken again."""

import struct
import zlib
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from sylvameter.functions import imaging
from sylvameter.sources import ingest, scenes
from sylvameter.sources.ingest import ImageIngest


def _png(rgb, size=None):
    h, w = size or rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    pictures = {f"good {i}.png": scenes.scene(i, 40, 48, 10 + i) for i in range(5)}
    for name, rgb in pictures.items():
        (source / name).write_bytes(_png(rgb))
    (source / "odd[1].png").write_bytes(_png(pictures["good 0.png"]))
    (source / "empty.png").write_bytes(b"")
    (source / "words.png").write_bytes(b"these are words")
    (source / "huge.png").write_bytes(_png(pictures["good 0.png"], (100_000, 100_000)))
    (source / "cut.png").write_bytes(_png(pictures["good 1.png"])[:60])
    (source / "none.png").write_bytes(_png(pictures["good 0.png"], (0, 9)))
    return source, pictures


def test_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xff\xdb" + struct.pack(">H", 4) + b"yy" + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, 1080, 1920, 3)
    assert ingest.header(jpeg + b"z" * 9) == ("jpeg", 1920, 1080) and ingest.header(jpeg[:30]) is None
    assert ingest.header(b"GIF89a" + struct.pack("<HH", 7, 9)) == ("gif", 7, 9)
    assert ingest.header(b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20)) == ("bmp", 30, 20)
    files = [("a", None, 0, b""), ("b", None, 3, b"abc"), ("c", None, None, None)]
    judged = {r.path: r.error for r in ingest.judged_files(spark.createDataFrame(files, ingest._FILES)).collect()}
    assert judged == {"a": "empty file", "b": "no image of a known format", "c": "empty file"}
    assert ingest.header(b"") is None and ingest.header(b"\x89PNG\r\n\x1a\n") is None and ingest.header(b"\xff\xd8\xff") is None


def test_ingest_measures_and_puts_aside(spark, folder, tmp_path):
    source, pictures = folder
    sink = ImageIngest(spark, str(tmp_path / "out"))
    sink.stream(str(source), str(tmp_path / "check"), batch_files=4).awaitTermination()
    got = {Path(r.image_id).name: r for r in sink.ingested().collect()}
    assert set(got) == {*pictures, "odd[1].png"}
    assert all(got[name].phash == imaging.perceptual_hash(rgb) and (got[name].width, got[name].height) == (48, 40) for name, rgb in pictures.items())
    aside = {Path(r.image_id).name: r.error for r in sink.quarantine().collect()}
    assert aside == {"words.png": "no image of a known format", "huge.png": "too many pixels", "cut.png": "no readable pixels", "none.png": "no pixels"}
    # what was taken is not taken again; a new file is
    (source / "later.png").write_bytes(_png(pictures["good 2.png"]))
    sink.stream(str(source), str(tmp_path / "check")).awaitTermination()
    assert sink.ingested().count() == 7 and sink.quarantine().count() == 4


def test_batch_that_fails_is_taken_again(spark, folder, tmp_path, monkeypatch):
    source, pictures = folder
    sink, whole, calls = ImageIngest(spark, str(tmp_path / "out")), ImageIngest.write, []

    def breaks(self, files, batch):
        whole(self, files, batch)
        if batch == 1 and not calls:
            calls.append(batch)
            raise OSError("lost after it was written")

    monkeypatch.setattr(ImageIngest, "write", breaks)
    with pytest.raises(StreamingQueryException):
        sink.stream(str(source), str(tmp_path / "check"), batch_files=4).awaitTermination()
    sink.stream(str(source), str(tmp_path / "check"), batch_files=4).awaitTermination()
    assert sink.ingested().count() == len(pictures) + 1 == sink.ingested().select("image_id").distinct().count() and sink.quarantine().count() == 4
