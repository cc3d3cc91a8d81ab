"""Descriptor matching: the two nearest neighbours of each query and the ratio test between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOUND = "q long, id long, d long"


def _two_nearest(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, id, squared distance) of the two nearest of a run of vectors for each query, itself aside; ties to the smaller id."""
    d = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :] - 2 * (queries @ vectors.T)
    d[own[:, None] == ids[None, :]] = np.iinfo(np.int64).max
    place = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :2]
    row = np.repeat(np.arange(len(own)), place.shape[1])
    place = place.ravel()
    good = own[row] != ids[place]
    row, place = row[good], place[good]
    return own[row], ids[place], d[row, place]


def ratio_test(vectors: DataFrame, asks: Column, ratio: tuple[int, int] = (9, 16), most_queries: int = 4096) -> DataFrame:
    """(q, nearest, d1, d2, kept) for the rows of ``vectors`` (id long, v array<long>) where ``asks``.

    d1 and d2 are the squared distances of the two nearest rows with other ids, and ``kept`` says that d1 is less than
    ``ratio`` (a fraction) of d2. Queries go in broadcast blocks of about ``most_queries``; a block meets the vectors as
    matrix products, run by run, and each run passes on two rows for each query. Vectors must be of one length and have
    integer components whose squared distances fit in 62 bits. A query with fewer than two others has no row.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "v").where("id is not null and v is not null")
    asking = rows.where(asks)
    n = max(1, -(-asking.count() // most_queries))
    out = None
    for i in range(n):
        block = sorted(asking.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).collect())
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in block], np.int64), np.array([r["v"] for r in block], np.int64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, queries = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows if len(own) else 0, 2048):
                    part = batch.slice(at, 2048)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    for k in range(0, len(own), 256):
                        found = _two_nearest(own[k : k + 256], queries[k : k + 256], ids, matrix)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["q", "id", "d"])

        near = rows.mapInArrow(run, _FOUND)
        out = near if out is None else out.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    two = out.withColumn("r", rank).where("r <= 2").groupBy("q").agg(F.min(F.struct("d", "id")).alias("a"), F.max(F.struct("d", "id")).alias("b"), F.count("*").alias("n"))
    d1, d2 = F.col("a.d"), F.col("b.d")
    return two.where("n = 2").select("q", F.col("a.id").alias("nearest"), d1.alias("d1"), d2.alias("d2"), (d1 * ratio[1] < d2 * ratio[0]).alias("kept"))


def match_histograms(rows: DataFrame, key: str) -> DataFrame:
    """(key, v, matched): what each source value becomes so that the source is distributed as the target, by ``key``.

    ``rows`` has key, source (true for the source, false for the target) and the whole number v. A value becomes the
    least target value whose share of values up to it is no smaller. Values are counted before rows meet, and a group
    is as large as its distinct values; groups without a source or a target have no rows.
    """
    counts = rows.groupBy(key, "source", "v").agg(F.count("*").alias("n"))
    side = Window.partitionBy(key, "source")
    up = counts.select(key, "source", "v", F.sum("n").over(side.orderBy("v")).alias("c"), F.sum("n").over(side).alias("t"))
    steps = F.array_sort(F.collect_list(F.struct("v", "c")))
    target = up.where("not source").groupBy(key).agg(steps.alias("steps"), F.first("t").alias("tt"))
    met = up.where("source").join(target, key)
    reached = F.filter("steps", lambda s: s["c"] * F.col("t") >= F.col("c") * F.col("tt"))
    return met.select(key, "v", F.get(reached, F.lit(0))["v"].alias("matched"))
