"""SimHash near-duplicate detection: fingerprints, BK-tree shards and components.

Two 64-bit fingerprints that differ in at most three bits agree wholly on at least one of any four disjoint blocks of
bits (on at least b - 3 of b blocks). So every link lies inside a shard of fingerprints that agree on a chosen set of
blocks. Each shard is a BK-tree in which a fingerprint follows only the edges whose key lies within the radius of its
distance to the node. Trees are built in the task that asks them rather than broadcast: all trees together grow with
the corpus, and a shard with its questions is what one task needs. The number of blocks follows the count of distinct
fingerprints so that shards stay small; a shard that is still large is split again, without loss, on blocks of the
bits not yet used, and one that stays large even then has its questions dealt to several tasks.

Shards emit spanning links only, never all pairs, and exact copies meet as one fingerprint before anything else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.bktree import spanning_links
from sylvameter.llm.common import own_exchange, slices
from sylvameter.llm.components import connected_components
from sylvameter.session import materialise

BITS = 64
_ALL = (1 << BITS) - 1
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have; zero for none."""
    n = len(hashes)
    parts = hashes.view(np.uint8).reshape(n, 8)
    if n < 400:
        counts = np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(parts[:, j], minlength=256) @ _OF_BYTE for j in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, shingles with repeats, XXH64."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed long. A null text counts as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(x.as_py() or b"", words, seed) for x in batch.column(1)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _pieces(mask: int, n: int) -> list[int]:
    """The set bits of ``mask`` in ``n`` disjoint pieces of like size."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return [sum(bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def _first_masks(n: int, radius: int, shard: int = 64) -> list[int]:
    """Masks such that fingerprints within ``radius`` agree on one of them; more bits for more fingerprints."""
    for blocks in range(radius + 1, radius + 4):
        kept = blocks - radius
        if n >> (BITS * kept // blocks) <= shard:
            break
    return [sum(c) for c in combinations(_pieces(_ALL, blocks), kept)]


def _shard_rows(rows: DataFrame, masks: dict[int, list[int]], seed: str) -> DataFrame:
    """Each row once for each mask of its own: key, mask, fp."""
    wider = F.create_map(
        *[x for m, more in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in more]))]
    )
    spread = rows.select("key", "fp", F.explode(F.element_at(wider, F.col("mask"))).alias("mask"))
    key: Column = F.xxhash64(F.lit(seed), "key", "mask", F.col("fp").bitwiseAND(F.col("mask")))
    return spread.select(key.alias("key"), "mask", "fp")


def links(nodes: DataFrame, n: int, radius: int = 3, large: int = 4096, levels: int = 2) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``nodes`` (fp), of which there are ``n``."""
    masks = {0: _first_masks(n, radius)}
    start = nodes.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).cast("long").alias("mask"))
    rows = _shard_rows(start, masks, "0")
    ready: list[DataFrame] = []
    for level in range(levels + 1):
        hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large))
        if hot.isEmpty():
            ready.append(rows.select("key", "fp", F.lit(True).alias("asks")))
            break
        ready.append(rows.join(hot, "key", "left_anti").select("key", "fp", F.lit(True).alias("asks")))
        big = rows.join(hot, "key")
        if level < levels:
            fixed = [m for more in masks.values() for m in more]
            masks = {m: [m | x for x in _pieces(_ALL & ~m, radius + 1)] for m in fixed}
            rows = materialise(_shard_rows(big, masks, str(level + 1)))
        else:  # every task has the whole shard and a share of its questions
            parts = F.ceil(F.col("n") / large).cast("int")
            dealt = big.select("key", "fp", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
            asks = F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part")
            ready.append(dealt.select(F.xxhash64("key", "part").alias("key"), "fp", asks.alias("asks")))
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(_first_masks(n, radius)) // 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        fp = table["fp"].to_numpy().view(np.uint64)
        a, b = spanning_links(table["key"].to_numpy(), fp, table["asks"].to_numpy(), radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return every.repartition(tasks, "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, large: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text); other columns are ignored.

    Documents link where their fingerprints differ in at most ``radius`` bits, and component_id is the smallest doc_id
    that links reach. Empty and null texts have fingerprint zero and link like any other; repeated rows and rows with
    a null doc_id stay, a null being the smallest id of no group unless it is alone. No rows give no rows.
    """
    marked = materialise(fingerprints(docs, words, seed))
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes, nodes.count(), radius, large))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "least")
    group = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(own_exchange(group, "root"), "root").select("fp", "component_id")
    # one row for each fingerprint, so that a fingerprint with a third of all rows is split on the side of documents
    final = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(own_exchange(final, "fp"), "fp", "left").select("doc_id", "fp", "component_id")
