"""One text of each group of near-duplicates: SimHash links first, then MinHash bands, and the shingles decide.

A text is its set of shingles of five lower-cased words (the whole text where it has fewer), each a 64-bit hash; texts
of one set are one node. Every link is verified by the Jaccard similarity of both sets.

The SimHash operator goes first: fingerprints of the shingles that differ in at most three bits, found in its BK-trees.
These links join what differs in little, groups of any size among them. They cannot reach a similarity of 0.8, where
fingerprints of 64 bits differ in about ten: bands of minima find the rest. Nodes that agree on a band share a bucket;
a pair of similarity 0.8 misses all of 20 bands of 5 with a chance of 4 in 10,000, one of 0.9 practically never.

Buckets are never paired off whole. First each node meets the least of its bucket, which is linear and joins a group
of any size. In a bucket that still has several components, sketches tell which nodes are near to another component. These are
searched in the bucket's task with their shingles at hand: the centre against all others, then each node outside of the
bucket's main component against the other components, nearest sketches first, until one of the component is similar.
What leaves the task is at most one link for each node. A pair is looked at in its first common bucket alone, and where
many nodes ask their questions are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import own_exchange, slices, unused
from sylvameter.llm import simhash
from sylvameter.llm.components import connected_components
from sylvameter.session import materialise

BANDS, ROWS = 20, 5
#: Equal minima of 100 from which a pair across components is verified: 3.75 standard errors below a similarity of 0.8.
NEAR = 65
_RNG = np.random.default_rng(42)
_ODD = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_FLIP = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``text``; none for a text without words."""
    w = (text or "").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ each[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(shingles: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """The least value of the shingles under each of the permutations."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), chunk):
        np.minimum(out, ((x[at : at + chunk] ^ _FLIP) * _ODD).min(axis=1), out=out)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def _marked(docs: DataFrame, words: int, names: dict[str, str]) -> DataFrame:
    """``docs`` with a key for each row, its node, fingerprint, buckets and sketch (a byte of each minimum), written to files."""
    kinds = (("node", "long"), ("print", "long"), ("buckets", "array<long>"), ("sketch", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            nodes, prints, buckets, sketches = [], [], [], []
            for x in batch.column(batch.schema.get_field_index("text")):
                found = shingle_set(x.as_py(), words)
                least = minima(found)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                prints.append(simhash.majority(found) if len(found) else 0)
                bands = least.reshape(BANDS, ROWS)
                buckets.append([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)] if len(found) else [])
                sketches.append(least.astype(np.uint8).tobytes())
            signed = lambda v: np.array(v, np.uint64).view(np.int64)
            new = [pa.array(signed(nodes)), pa.array(signed(prints)), pa.array([signed(b) for b in buckets], pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(names[k] for k, _ in kinds)])

    keyed = docs.withColumn(names["key"], F.monotonically_increasing_id())
    schema = keyed.select("*", *[F.lit(None).cast(kind).alias(names[k]) for k, kind in kinds]).schema
    return materialise(keyed.mapInArrow(run, schema))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(64)(lambda text: shingle_set(text, words))
        for batch in slices(batches, "text_a"):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similarity(held(x), held(y)) >= least for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(own_exchange(texts, "node").toDF("a", "text_a"), "a")
    both = first.join(own_exchange(texts, "node").toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def _print_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes with one fingerprint, each with the least of them, and of fingerprints that SimHash links."""
    prints = materialise(nodes.groupBy("print").agg(F.min("node").alias("least")))
    same = nodes.join(own_exchange(prints, "print"), "print").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(prints.select(F.col("print").alias("fp")), prints.count(), radius).distinct()
    for side in ("a", "b"):
        near = near.join(own_exchange(prints, "print").toDF(side, f"node_{side}"), side)
    return same.unionByName(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (node, text); the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _agreement(i: int, sketch: np.ndarray, bands: np.ndarray, band: int) -> np.ndarray:
    """Equal minima of node ``i`` and each node of a bucket; -1 for pairs that an earlier ``band`` has in a bucket."""
    equal = (sketch == sketch[i]).sum(axis=1)
    equal[(bands[:, :band] == bands[i, :band]).any(axis=1)] = -1
    return equal


def in_question(component: np.ndarray, sketch: np.ndarray, bands: np.ndarray, band: int, asks: np.ndarray) -> np.ndarray:
    """The places of one bucket that are near to a node of another component, and those of these nodes."""
    found = np.zeros(len(component), bool)
    for i in np.flatnonzero(asks):
        near = (component != component[i]) & (_agreement(i, sketch, bands, band) >= NEAR)
        if near.any():
            found[i] = True
            found |= near
    return np.flatnonzero(found)


def links_across(
    node: np.ndarray, component: np.ndarray, sketch: np.ndarray, bands: np.ndarray, band: int, shingles: list[np.ndarray], asks: np.ndarray, least: float
) -> list[tuple[int, int]]:
    """Links (a, b) between the components of one bucket, at most one for each node.

    ``bands`` has the buckets of each node: pairs that share one before ``band`` are left to that one.
    """
    _, group = np.unique(component, return_inverse=True)
    links: list[tuple[int, int]] = []

    def meet(i: int, j: int) -> None:
        if similarity(shingles[i], shingles[j]) >= least:
            links.append((int(node[i]), int(node[j])))
            group[group == group[j]] = group[i]

    # the centre is the node that agrees most with the commonest minimum of each place
    common = np.array([np.bincount(c).argmax() for c in sketch.T], np.uint8)
    centre = int((sketch == common).sum(axis=1).argmax())
    for j in np.flatnonzero(_agreement(centre, sketch, bands, band) >= NEAR):
        if group[j] != group[centre]:
            meet(centre, int(j))
    for i in np.flatnonzero(asks):
        if (group == group[0]).all():
            break
        equal = _agreement(i, sketch, bands, band)
        for j in np.argsort(-equal, kind="stable"):
            if equal[j] < NEAR:
                break
            if group[j] != group[i]:
                meet(int(i), int(j))
    return links


def _by_bucket(rows: DataFrame, large: int, search: Callable[[list[tuple], np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``search`` makes of the rows of each bucket, and of which of them ask; many questions go to several tasks.

    ``rows`` has bucket, outside (of the bucket's main component: these ask), n (how many do), node and other columns.
    One bucket is held at a time.
    """
    parts = F.greatest(F.ceil(F.col("n") / large), F.lit(1)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    asks = F.col("outside") & (F.pmod(F.xxhash64("node"), F.col("parts")) == F.col("part"))
    others = [c for c in rows.columns if c not in ("bucket", "n", "outside")]
    dealt = dealt.select(F.xxhash64("bucket", "part").alias("key"), asks.alias("asks"), "bucket", *others)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches, "shingles") if "shingles" in others else batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield search([r[2:] for r in held], np.array([r[1] for r in held]))
                    held = []
                held.append(row)
        if held:
            yield search([r[2:] for r in held], np.array([r[1] for r in held]))

    return dealt.repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(run, schema)


def _matrices(members: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of rows (bucket, node, component, sketch, buckets, ...): nodes, components, sketches, buckets, and the band."""
    bucket, node, component, sketch, buckets = (x for x, _ in zip(zip(*members, strict=True), range(5), strict=False))
    matrix = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, BANDS * ROWS)
    return np.array(node), np.array(component), matrix, np.array(buckets), buckets[0].index(bucket[0])


def _across(rows: DataFrame, shingles_of: Callable[[DataFrame], DataFrame], least: float, large: int) -> DataFrame:
    """Links (a, b) across components of one bucket, of rows (bucket, n, outside, node, component, sketch, buckets).

    Sketches tell which nodes are in question; only their shingles (``shingles_of`` nodes) go to the buckets. Of two
    nodes of different components one at least is outside of the bucket's main component, so those alone ask.
    """

    def questions(members: list[tuple], asks: np.ndarray) -> pa.RecordBatch:
        node, component, sketch, bands, band = _matrices(members)
        found = in_question(component, sketch, bands, band, asks)
        both = [pa.array([members[0][0]] * len(found), pa.int64()), pa.array(node[found], pa.int64())]
        return pa.RecordBatch.from_arrays(both, ["bucket", "node"])

    def links(members: list[tuple], asks: np.ndarray) -> pa.RecordBatch:
        node, component, sketch, bands, band = _matrices(members)
        found = links_across(node, component, sketch, bands, band, [np.frombuffer(m[5], np.uint64) for m in members], asks, least)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    asked = materialise(_by_bucket(rows, large, questions, "bucket long, node long").distinct())
    few = rows.join(own_exchange(asked, "bucket", "node"), ["bucket", "node"], "left_semi")
    few = few.join(own_exchange(shingles_of(asked.select("node")), "node"), "node")
    return _by_bucket(few.select("bucket", "n", "outside", "node", "component", "sketch", "buckets", "shingles"), large, links, "a long, b long")


def representatives(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3, large: int = 1024) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one row of each group of near-duplicates stays.

    Rows link where the Jaccard similarity of their shingles is ``least`` or more, and groups are what links reach. The
    row with the smallest doc_id stays, a null id coming last; of rows with equal ids one stays. Every row counts by
    itself, so a null or repeated doc_id loses nothing. Null and blank texts are one group. No rows give no rows.
    """
    names = {k: unused(f"{k}_", docs.columns) for k in ("key", "node", "print", "buckets", "sketch")}
    written = _marked(docs, words, names)
    rows = written.select(F.col("doc_id"), *[F.col(v).alias(k) for k, v in names.items()])
    # of the rows of a node any one has its shingles: the first key's text speaks for it
    nodes = materialise(rows.groupBy("node").agg(F.min("key").alias("key"), F.min("print").alias("print")))
    with_text = written.select(F.col(names["key"]).alias("key"), "text")

    def texts(wanted: DataFrame) -> DataFrame:
        keys = wanted.distinct().join(nodes.select("node", "key"), "node")
        return with_text.join(own_exchange(keys, "key"), "key").select("node", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        return materialise(_verified(pairs, materialise(texts(both)), words, least))

    def component(of: DataFrame) -> DataFrame:
        return of.join(own_exchange(roots, "node"), "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")

    links = verified(materialise(_print_links(nodes, radius)))
    roots = materialise(connected_components(links))
    spoken = rows.join(own_exchange(nodes.select("key"), "key"), "key", "left_semi").select("node", "buckets", "sketch")
    spread = component(spoken.select("node", F.explode("buckets").alias("bucket")))
    buckets = spread.groupBy("bucket").agg(F.min(F.struct("component", "node")).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = materialise(spread.join(own_exchange(buckets, "bucket"), "bucket"))
    apart = members.where(F.col("component") != F.col("pivot.component"))
    pairs = apart.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
    pairs = materialise(pairs)
    links = links.unionByName(verified(pairs))
    roots = materialise(connected_components(links))
    known = component(members.select("bucket", "n", "node"))
    sizes = known.where("n > 2").groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = F.max_by("component", F.struct("size", "component")).alias("main")
    mixed = sizes.groupBy("bucket").agg(main, (F.sum("size") - F.max("size")).alias("n")).where("n > 0")
    left = known.drop("n").join(own_exchange(mixed, "bucket"), "bucket").withColumn("outside", F.col("component") != F.col("main"))
    left = left.join(own_exchange(spoken.select("node", "sketch", "buckets"), "node"), "node")
    left = materialise(left.select("bucket", "n", "outside", "node", "component", "sketch", "buckets"))
    late = materialise(_across(left, lambda wanted: _shingles(texts(wanted), words), least, large))
    if not late.isEmpty():
        roots = connected_components(links.unionByName(late))
    grouped = component(rows.select("node", "doc_id", "key"))
    best = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    stays = best.select(F.col("best.key").alias(names["key"]))
    kept = written.join(own_exchange(stays, names["key"]), names["key"], "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
