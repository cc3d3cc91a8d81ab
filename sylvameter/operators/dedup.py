"""Perceptual-hash duplicates: nearest earlier asset by Hamming distance, by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvameter.session import materialise, shared_path

#: The largest distances of a duplicate and of a case for review.
QUARANTINE, REVIEW = 8, 12
HASH_BITS = 64
#: Bands of a hash, and the most bits in which the values of a band may differ: 5 and 1 reach every hash within 9 bits.
BANDS, FLIPS = 5, 1


def hash_halves(hex16: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of a hash of 16 hex digits, as longs; null where it is none."""
    sound = F.when(hex16.rlike("^[0-9a-fA-F]{16}$"), hex16)
    return F.conv(F.substring(sound, 1, 8), 16, 10).cast("long"), F.conv(F.substring(sound, 9, 8), 16, 10).cast("long")


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def banded(rows: DataFrame, bits: int = HASH_BITS, bands: int = BANDS) -> DataFrame:
    """``rows`` (hi, lo) once for each band of the hash, with its number and value."""
    structs = [F.struct(F.lit(i).alias("band"), _slice(start, width).alias("value")) for i, (start, width) in enumerate(_bands(bits, bands))]
    return rows.where("hi is not null and lo is not null").select("*", F.inline(F.array(*structs)))


def _bands(bits: int, bands: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each band; together they are the whole hash."""
    edges = [i * bits // bands for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _slice(start: int, width: int) -> Column:
    """``width`` bits of the hash from bit ``start``, of which 32 are in lo."""
    low = F.shiftrightunsigned("lo", start) if start < 32 else F.shiftrightunsigned("hi", start - 32)
    if start < 32 < start + width:
        low = low.bitwiseOR(F.shiftleft("hi", 32 - start))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, most: int) -> list[int]:
    """Every mask of at most ``most`` of ``width`` bits."""
    return [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(width), n)]


def _as_corpus(corpus: DataFrame, same_project: bool) -> DataFrame:
    """(c_hi, c_lo, c_project, c): one row for each distinct hash (of a project), with its first (c_seq, c_id)."""
    project = F.col("project_id") if same_project else F.lit(None).cast("string")
    rows = corpus.where("hi is not null and lo is not null").select(F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), project.alias("c_project"), F.struct(F.col("seq").alias("c_seq"), F.col("asset_id").alias("c_id")).alias("c"))
    return rows.groupBy("c_hi", "c_lo", "c_project").agg(F.min("c").alias("c"))


def _least(joined: DataFrame, earlier_only: bool) -> DataFrame:
    """(asset_id, best) of probes joined with corpus rows: the nearest of those that may be matched, ties to the smaller seq."""
    d = hamming(F.col("hi"), F.col("lo"), F.col("c_hi"), F.col("c_lo"))
    kept = joined.where(F.col("c.c_seq") < F.col("seq")) if earlier_only else joined
    return kept.select("asset_id", F.struct(d.alias("d"), "c.c_seq", "c.c_id").alias("best")).groupBy("asset_id").agg(F.min("best").alias("best"))


def nearest(
    probes: DataFrame, corpus: DataFrame, *, same_project: bool = False, earlier_only: bool = False, most_distance: int | None = None, bands: int = BANDS
) -> DataFrame:
    """Each probe (asset_id, hi, lo, project_id, seq) with match_id and distance of its nearest corpus row.

    Ties go to the smaller seq, a distance of all 64 bits is no match, an asset matches itself only as a resubmission; a
    null hash has no match. The search is exact and grows in radius: first equal hashes; then, in each band of the hash,
    equal values; then values of another bit, if that covers ``most_distance``. Hashes less than ``bands`` times one more
    than these bits apart agree so on a band, so a probe whose nearest is within that radius is done. With
    ``most_distance`` nothing farther is looked for; where the radius does not cover it, what is left is compared with the
    whole corpus in blocks of arrays.

    Spark takes a table with exploded bands for as small as its file and would broadcast it, so these joins are told not to.
    """
    rows = materialise(_as_corpus(corpus, same_project))
    return _nearest(probes, rows, _in_bands(rows, bands), same_project, earlier_only, most_distance, bands)


def _in_bands(rows: DataFrame, bands: int) -> DataFrame:
    halves = rows.withColumnRenamed("c_hi", "hi").withColumnRenamed("c_lo", "lo")
    return banded(halves, bands=bands).withColumnRenamed("hi", "c_hi").withColumnRenamed("lo", "c_lo")


def _nearest(probes: DataFrame, corpus: DataFrame, in_bands: DataFrame, same_project: bool, earlier_only: bool, most_distance: int | None, bands: int) -> DataFrame:
    project = F.col("project_id") if same_project else F.lit(None).cast("string")
    asked = probes.where("hi is not null and lo is not null").select("asset_id", "hi", "lo", project.alias("project_id"), "seq")
    left, found = materialise(asked), []

    def joined(rows: DataFrame, to: DataFrame, *on: Column) -> DataFrame:
        terms = [*on, *([F.col("project_id") == F.col("c_project")] if same_project else [])]
        return _least(rows.join(to, reduce(lambda a, b: a & b, terms)), earlier_only)

    equal = materialise(joined(left, corpus, F.col("hi") == F.col("c_hi"), F.col("lo") == F.col("c_lo")))
    found.append(equal)
    left = left.join(equal, "asset_id", "left_anti")
    radius = 0
    for flips in (0, FLIPS):
        if most_distance is not None and radius >= most_distance or flips and (most_distance is None or most_distance >= bands * (flips + 1)):
            break  # enough, or blocks have to look at what is left anyway
        radius = bands * (flips + 1) - 1
        masks = [_flips(width, flips) for _, width in _bands(HASH_BITS, bands)]
        varied = banded(left, bands=bands).withColumn("mask", F.explode(F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("band") + 1)))
        keyed = varied.select("asset_id", "hi", "lo", "project_id", "seq", F.col("band").alias("p_band"), F.col("value").bitwiseXOR(F.col("mask")).alias("p_value"))
        near = materialise(joined(keyed.hint("merge"), in_bands.hint("merge"), F.col("p_band") == F.col("band"), F.col("p_value") == F.col("value")).where(F.col("best.d") <= radius))
        found.append(near)
        left = left.join(near, "asset_id", "left_anti")
    if most_distance is None or most_distance > radius:
        found.append(_by_blocks(left, corpus, earlier_only))
    best = reduce(DataFrame.unionByName, found)
    if most_distance is not None:
        best = best.where(F.col("best.d") <= most_distance)
    return probes.join(best, "asset_id", "left").select(*probes.columns, F.col("best.c_id").alias("match_id"), F.col("best.d").alias("distance"))


def _by_blocks(probes: DataFrame, corpus: DataFrame, earlier_only: bool, block: int = 8192) -> DataFrame:
    """(asset_id, best) over the whole corpus: every block of probes meets every block of the corpus as arrays.

    A block of some 8,192 rows is one row here, and what leaves a meeting is one candidate for each probe.
    """
    n_probes, n_corpus = (max(1, -(-df.count() // block)) for df in (probes, corpus))
    id_kind, seq_kind = (corpus.schema["c"].dataType[f].dataType.simpleString() for f in ("c_id", "c_seq"))

    def packed(df: DataFrame, n: int, name: str, *fields: str) -> DataFrame:
        keyed = df.select(F.pmod(F.xxhash64(*fields[:3]), F.lit(n)).alias(f"{name}_block"), F.struct(*fields).alias("r"))
        return keyed.groupBy(f"{name}_block").agg(F.collect_list("r").alias(name))

    left = packed(probes, n_probes, "p", "hi", "lo", "seq", "asset_id", "project_id").withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_corpus - 1)).cast("array<bigint>")))
    right = packed(corpus.select("c_hi", "c_lo", "c.c_seq", "c.c_id", "c_project"), n_corpus, "c", "c_hi", "c_lo", "c_seq", "c_id", "c_project")
    names = ("hi", "lo", "seq", "asset_id", "project_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                p, c = (pa.RecordBatch.from_struct_array(batch.column(i)[at].values) for i in range(2))
                yield _closest(p, c, earlier_only, names)

    schema = f"asset_id {probes.schema['asset_id'].dataType.simpleString()}, d int, c_seq {seq_kind}, c_id {id_kind}"
    met = left.hint("merge").join(right.hint("merge"), "c_block").select("p", "c").repartition(max(1, n_probes * n_corpus)).mapInArrow(meet, schema)
    return met.where("d < 64").select("asset_id", F.struct("d", "c_seq", "c_id").alias("best")).groupBy("asset_id").agg(F.min("best").alias("best"))


def _closest(p: pa.RecordBatch, c: pa.RecordBatch, earlier_only: bool, names: tuple[str, ...], rows: int = 256) -> pa.RecordBatch:
    """The nearest corpus row of each probe of a block, ties to the smaller seq; a distance of 64 where there is none."""
    c = pa.Table.from_batches([c]).sort_by([(c.schema.names[2], "ascending"), (c.schema.names[3], "ascending")])
    (ph, pl, ps, pids, pp), (ch, cl, cs, cids, cp) = ([t.column(i) for i in range(5)] for t in (p, c))
    projects = cp.null_count < len(cp) or pp.null_count < len(pp)
    whole = [np.asarray(hi).astype(np.uint64) << np.uint64(32) | np.asarray(lo).astype(np.uint64) for hi, lo in ((ph, pl), (ch, cl))]
    codes = {v: i for i, v in enumerate({*pp.to_pylist(), *cp.to_pylist()})} if projects else {}
    own, other = (np.array([-1 - side if v is None else codes[v] for v in x.to_pylist()]) if projects else None for side, x in enumerate((pp, cp)))
    pseq, cseq = np.asarray(ps), np.asarray(cs)
    at, least = np.empty(len(pseq), np.int64), np.empty(len(pseq), np.int32)
    for i in range(0, len(pseq), rows):
        d = np.bitwise_count(whole[0][i : i + rows, None] ^ whole[1][None, :]).astype(np.int32)
        if earlier_only:
            d[cseq[None, :] >= pseq[i : i + rows, None]] = HASH_BITS
        if projects:
            d[own[i : i + rows, None] != other[None, :]] = HASH_BITS
        at[i : i + rows] = d.argmin(axis=1)
        least[i : i + rows] = d.min(axis=1)
    taken = pa.array(at)
    return pa.RecordBatch.from_arrays([pids, pa.array(least), cs.take(taken).combine_chunks(), cids.take(taken).combine_chunks()], ["asset_id", "d", "c_seq", "c_id"])


class HashCorpus:
    """A kept corpus of hashes: assets are appended, and a search reads its files of bands.

    ``rows`` has the assets by append, ``bands`` each of them once by band of its hash. An append counts as a whole or not
    at all: it is named by ``batch``, and one that is repeated under its name is written over.
    """

    _COLUMNS = ("asset_id", "hi", "lo", "project_id", "seq")

    def __init__(self, spark: SparkSession, folder: str | None = None, bands: int = BANDS) -> None:
        self.spark, self.bands = spark, bands
        self.folder = folder or shared_path(spark, "hashes")

    def append(self, assets: DataFrame, batch: str) -> None:
        """Take in ``assets`` (asset_id, hi, lo, project_id, seq); those without a hash are left out."""
        kept = assets.where("hi is not null and lo is not null").select(*self._COLUMNS)
        kept.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        own = self.spark.read.schema(kept.schema).parquet(f"{self.folder}/rows/batch={batch}")
        banded(own, bands=self.bands).repartition("band").write.mode("overwrite").partitionBy("band").parquet(f"{self.folder}/bands/batch={batch}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows").select(*self._COLUMNS)

    def nearest(self, probes: DataFrame, *, same_project: bool = False, earlier_only: bool = False, most_distance: int | None = None) -> DataFrame:
        """As ``nearest`` over all that was appended."""
        project = F.col("project_id") if same_project else F.lit(None).cast("string")
        rows = self.spark.read.parquet(f"{self.folder}/bands")
        first = F.min(F.struct(F.col("seq").alias("c_seq"), F.col("asset_id").alias("c_id"))).alias("c")
        in_bands = rows.groupBy("band", "value", F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), project.alias("c_project")).agg(first)
        whole = materialise(_as_corpus(self.rows(), same_project))
        return _nearest(probes, whole, materialise(in_bands), same_project, earlier_only, most_distance, self.bands)


def verdict(distance: Column, asset: Column | None = None, match: Column | None = None) -> Column:
    """QUARANTINE up to 8 bits, REVIEW up to 12, else UNIQUE; no match is UNIQUE; a resubmission is no duplicate."""
    same = F.lit(False) if asset is None or match is None else F.coalesce(asset == match, F.lit(False))
    return (
        F.when(distance.isNull() | (distance > REVIEW), "UNIQUE").when(same, "RESUBMISSION").when(distance <= QUARANTINE, "QUARANTINE_DUPLICATE").otherwise("REVIEW_SIMILAR")
    )


def sign_bits(vector: Column, n: int) -> Column:
    """The signs of the first ``n`` components of an array as a number, the first one lowest."""
    bits = F.transform(F.slice(vector, 1, n), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


def banded_pairs(left: DataFrame, radius: int, bits: int = 32) -> DataFrame:
    """(a, b, distance) of rows (asset_id, hi, lo) at most ``radius`` apart: they agree on one of radius + 1 bands."""
    keyed = banded(left.select("asset_id", "hi", "lo"), 2 * bits, radius + 1)
    other = keyed.select(F.col("asset_id").alias("b"), F.col("hi").alias("h2"), F.col("lo").alias("l2"), "band", "value")
    near = keyed.join(other, ["band", "value"]).where(F.col("asset_id") < F.col("b")).withColumn("distance", hamming(F.col("hi"), F.col("lo"), F.col("h2"), F.col("l2")))
    return near.where(F.col("distance") <= radius).select(F.col("asset_id").alias("a"), "b", "distance").distinct()
