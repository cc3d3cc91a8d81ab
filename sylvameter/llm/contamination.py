"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity to the whole of it, which MinHash cannot see. So the
search is partitioned by size: items fall into classes by their number of shingles, each class doubling the last, and
a document is looked at, for each class, in windows of two adjacent blocks of the class's size. A passage as long as
an item of the class lies wholly in one window and has a similarity to it of about a quarter at least, of an eighth in
the smallest class. A window is a candidate if any of 64 MinHash values equals the item's: the chance to miss an item
that is there is about one in a million, and 2 in 10,000 for an item of one shingle. Each candidate is then verified by the exact
containment of the item's word shingles in the whole document.

Items are held in blocks that are bounded in number and in bytes, and documents are read once for each block; nothing is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import slices
from sylvameter.session import materialise

_WORD = re.compile(r"[^\W_]+")
WORDS = 5
LEAST = 0.8
HASHES = 64
_SMALLEST = 4  # shingles of the smallest class
_SEGMENT = 1 << 15  # shingles that are hashed at once
_random = np.random.default_rng(20240229)
_MULTIPLY = (_random.integers(1, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)[:, None]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def _word_hashes(words: list[str]) -> np.ndarray:
    known = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash for each run of ``words`` word hashes."""
    n = len(hashes) - words + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words if n > 0 else 0):
            out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _minima(shingles: np.ndarray, block: int) -> np.ndarray:
    """MinHash values (HASHES, blocks) of consecutive blocks of shingles."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    values = low[None, :] * _MULTIPLY
    values += _ADD
    return np.minimum.reduceat(values, np.arange(0, len(low), block), axis=1)


@dataclass
class Item:
    item_id: int | None
    words: list[str]
    size: int = WORDS
    shingles: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        self.size = min(WORDS, len(self.words))
        self.shingles = frozenset(" ".join(self.words[i : i + self.size]) for i in range(len(self.words) - self.size + 1))

    def containment(self, words: list[str]) -> float:
        """The share of the item's shingles that the whole document has."""
        return self.share(_joined(words, self.size))

    def share(self, held: set[str]) -> float:
        """As ``containment``, from the document's shingles of the item's size."""
        return len(self.shingles & held) / len(self.shingles)


def _joined(words: list[str], n: int) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


class Index:
    """MinHash values of items by size class, and exact hashes of items that are shorter than a shingle."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.items = [x for x in (Item(i, words_of(t)) for i, t in items) if x.words]
        self.short: dict[int, dict[int, list[int]]] = {}
        members: dict[int, list[int]] = {}
        for i, item in enumerate(self.items):
            if item.size < WORDS:
                key = int(_shingle_hashes(_word_hashes(item.words), item.size)[0])
                self.short.setdefault(item.size, {}).setdefault(key, []).append(i)
            else:
                block = _SMALLEST
                while block < len(item.shingles):
                    block *= 2
                members.setdefault(block, []).append(i)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for block, those in sorted(members.items()):
            table = np.zeros((HASHES, 1 << 16), bool)
            keys, owners = [], []
            for i in those:
                h = _shingle_hashes(_word_hashes(self.items[i].words), WORDS)
                signature = _minima(h, len(h))[:, 0]
                table[np.arange(HASHES), signature & 0xFFFF] = True
                keys.append(np.arange(HASHES, dtype=np.uint64) << np.uint64(32) | signature)
                owners.append(np.full(HASHES, i))
            order = np.argsort(key := np.concatenate(keys), kind="stable")
            self.classes[block] = (table, key[order], np.concatenate(owners)[order])

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window of the document."""
        found: set[int] = set()
        for size, keys in self.short.items():
            for h in set(_shingle_hashes(hashes, size).tolist()) & keys.keys():
                found.update(keys[h])
        shingles = _shingle_hashes(hashes, WORDS)
        if not self.classes or not len(shingles):
            return found
        overlap = 2 * max(self.classes)
        for at in range(0, len(shingles), _SEGMENT):
            part = shingles[at : at + _SEGMENT + overlap]
            smallest = min(self.classes)
            minima, block = _minima(part, smallest), smallest
            while True:
                if block in self.classes:
                    table, keys, owners = self.classes[block]
                    windows = np.minimum(minima[:, :-1], minima[:, 1:]) if minima.shape[1] > 1 else minima
                    k, w = np.nonzero(table[np.arange(HASHES)[:, None], windows & np.uint32(0xFFFF)])
                    if len(k):
                        wanted = np.unique(k.astype(np.uint64) << np.uint64(32) | windows[k, w])
                        low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
                        for a, b in zip(low[low < high], high[low < high], strict=True):
                            found.update(owners[a:b].tolist())
                if block >= max(self.classes):
                    break
                if minima.shape[1] % 2:
                    minima = np.concatenate([minima, minima[:, -1:]], axis=1)
                minima, block = np.minimum(minima[:, ::2], minima[:, 1::2]), block * 2
        return found

    def matches(self, text: str | None, least: float = LEAST) -> list[tuple[int | None, float, int]]:
        """(item_id, containment, shingles) of the items that the document contains to ``least`` or more."""
        words = words_of(text)
        if not words:
            return []
        near = [self.items[i] for i in sorted(self.candidates(_word_hashes(words)))]
        held = {n: _joined(words, n) for n in {item.size for item in near}}
        found = [(item, item.share(held[item.size])) for item in near]
        return [(item.item_id, share, len(item.shingles)) for item, share in found if share >= least]


def _blocks(benchmark: DataFrame, most_items: int, most_bytes: int) -> Iterator[tuple[Index, bool]]:
    """Indexes over at most about ``most_items`` items and ``most_bytes`` bytes of text each, and whether there are several."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-size[0] // most_items), -(-size[1] // most_bytes))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield Index([(r["item_id"], r["text"]) for r in rows]), n > 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, most_items: int = 20_000, most_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles) for each document row and each item that it contains.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. An item of fewer than five words is one shingle of
    all its words; one without words is in no document, and a null or empty document has no item. Repeated rows of
    either side give repeated rows, texts of any length are searched whole, other columns are ignored. Empty tables give
    no rows. An index goes to the driver and, broadcast, to executors; its texts take about ``most_bytes`` (a longer item
    is a block of its own), and with what is built from them some ten times that. Of several indexes one is there at a
    time: what it finds is written before the next is built.
    """
    schema = "doc_id long, item_id long, containment double, n_shingles long"
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    result = spark.createDataFrame([], schema)
    for index, several in _blocks(benchmark, most_items, most_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in shared.value.matches(t, least)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "containment", "n_shingles"]
                )

        found = narrow.mapInArrow(run, schema)
        if several:
            found = materialise(found)
            shared.destroy()
        result = result.unionByName(found)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, most_items: int = 20_000, most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns of any name, that contain no item of ``benchmark``; else as ``find_leaks``."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    for index, several in _blocks(benchmark, most_items, most_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, place):
                clean = [not shared.value.matches(t, least) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = materialise(docs)
            shared.destroy()
    return docs


def oracle_sql(least: float = LEAST) -> str:
    """The same in DuckDB by exact containment alone, for documents (doc_id, text) and benchmark (item_id, text)."""
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS MATERIALIZED (
  SELECT row_number() OVER () AS k, item_id, w, least({WORDS}, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
), item_shingles AS (
  SELECT DISTINCT k, n, array_to_string(w[j:j + n - 1], ' ') AS s FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS j FROM i)
), sizes AS (
  SELECT k, count(*) AS n_shingles FROM item_shingles GROUP BY k
), doc_shingles AS (
  SELECT DISTINCT r, n, array_to_string(w[j:j + n - 1], ' ') AS s
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), shared AS (
  SELECT r, k, count(*) AS c FROM doc_shingles JOIN item_shingles USING (n, s) GROUP BY r, k
)
SELECT doc_id, item_id, c / n_shingles AS containment, CAST(n_shingles AS BIGINT) AS n_shingles
FROM shared JOIN sizes USING (k) JOIN d USING (r) JOIN i USING (k) WHERE c / n_shingles >= {least}
"""
