"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over slices of the components; each slice of each run of vectors is a list. Phase 1
gathers, for each query, the best k of every list, with their full scores: the k-th best of them is a safe cutoff t, as
k candidates reach it. Phase 2 broadcasts the cutoffs, and of each list only entries that reach t over the number of
slices pass: a vector that reaches t has one such entry at least. An unknown partial score is below that bound, and at
most the product of the two norms, so a vector whose known partial scores cannot make up t goes as well. Phase 3
resolves the unknown partial scores of the others, slice by slice, each ruling more of them out, and passes on at most
k that reach t. The argument needs no sign: it holds for negative scores too.

Queries go in blocks of bounded size; each block is broadcast and meets all vectors, run by run, as matrix products.
No pair of a query and a vector is ever a row but the few that are passed on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvameter.session import materialise

SLICES = 4
_EXACT = 2**53


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, v): a key for each row, and floor(scale * x) of each component.

    Rows with a null vector, or with null or non-finite components, go.
    """
    x = F.col("embedding").cast("array<double>")
    finite = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    return vectors.where(finite & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), whole.alias("v")
    )


def product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where every sum is exact in them."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1]
    if most < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def _matrices(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) of runs of vectors with one length, at most ``most`` vectors each."""
    for batch in batches:
        keys, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        lists = batch.column(2)
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lengths = np.diff(starts)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for at in range(0, len(rows), most):
                part = rows[at : at + most]
                yield keys[part], ids[part], flat[starts[part][:, None] + np.arange(n)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places (queries, up to k) of the largest scores of each row, ties to the smaller id."""
    if scores.shape[1] > 4 * k:
        # all that may be in the best k: nothing below the k-th largest score, and ties in order of the id
        order = np.argsort(ids, kind="stable")
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        out = np.empty((len(scores), k), np.int64)
        ranked = scores[:, order]
        for i, least in enumerate(floor):
            near = np.flatnonzero(ranked[i] >= least)
            above = near[ranked[i, near] > least]
            ties = near[ranked[i, near] == least][: k - len(above)]
            pick = np.concatenate([above, ties])
            out[i] = order[pick[np.argsort(-ranked[i, pick], kind="stable")]]
        return out
    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]


class Block:
    """Queries by vector length: rows, ids and matrices, and the cutoffs by row once they are known.

    ``passed`` counts what each phase looked at and passed on.
    """

    def __init__(self, queries: list, cutoffs: dict[int, int] | None = None) -> None:
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(r["v"]) for r in queries}):
            own = [r for r in queries if len(r["v"]) == n]
            matrix = np.array([r["v"] for r in own], np.int64).reshape(len(own), n)
            self.by_length[n] = (np.array([r["row"] for r in own]), np.array([r["vec_id"] for r in own]), matrix)
        self.cutoffs = cutoffs
        self.passed: Counter = Counter()

    def lists(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query rows, query ids, vector rows, vector ids, scores) that this run of vectors passes on in the phase at hand."""
        n = matrix.shape[1]
        if n not in self.by_length:
            return
        own, names, queries = self.by_length[n]
        cuts = [slice(n * i // SLICES, n * (i + 1) // SLICES) for i in range(SLICES)]
        phase = self._gather if self.cutoffs is None else self._resolve
        for at in range(0, len(own), 256):
            q = slice(at, at + 256)
            row, place, score = phase(own[q], queries[q], rows, ids, matrix, cuts, k)
            self.passed["passed"] += len(row)
            yield own[q][row], names[q][row], rows[place], ids[place], score

    @staticmethod
    def _gather(own, queries, rows, ids, matrix, cuts, k):
        """Phase 1: the best k of each list, with their full scores."""
        itself = own[:, None] == rows[None, :]
        places, total = [], 0
        for c in cuts:
            p = product(queries[:, c], matrix[:, c])
            total = total + p
            p[itself] = np.iinfo(np.int64).min
            places.append(_best(p, ids, min(k, p.shape[1])))
        place = np.concatenate(places, axis=1)
        row = np.repeat(np.arange(len(own)), place.shape[1])
        row, place = np.unique(np.stack([row, place.ravel()]), axis=1)
        other = ~itself[row, place]
        row, place = row[other], place[other]
        return row, place, total[row, place]

    def _resolve(self, own, queries, rows, ids, matrix, cuts, k):
        """Phases 2 and 3: entries that reach their share of the cutoff, then the rest of the score for those vectors alone."""
        lowest = -(1 << 62)
        t = np.array([self.cutoffs.get(int(i), lowest) for i in own], np.int64)
        share = -(-t // len(cuts))  # the least integer that reaches it
        unknown, entries = np.full((len(own), len(rows)), len(cuts), np.int8), []
        for c in cuts:
            p = product(queries[:, c], matrix[:, c])
            row, place = np.nonzero(p >= share[:, None])
            unknown[row, place] -= 1
            entries.append((row, place, p[row, place]))
        candidate = unknown < len(cuts)
        candidate &= own[:, None] != rows[None, :]
        row, place = np.nonzero(candidate)
        at = np.full(candidate.shape, -1, np.int64)
        at[row, place] = np.arange(len(row))
        partial, resolved = np.zeros((len(cuts), len(row)), np.int64), np.zeros((len(cuts), len(row)), bool)
        for i, (r, p, value) in enumerate(entries):
            found = at[r, p]
            partial[i, found[found >= 0]], resolved[i, found[found >= 0]] = value[found >= 0], True
        self.passed["pairs"] += candidate.size
        self.passed["entries"] += len(row)
        most, bounds = partial.sum(axis=0), np.zeros_like(partial)
        for i, c in enumerate(cuts):
            rest = np.flatnonzero(~resolved[i])
            norms = np.sqrt((queries[:, c].astype(float) ** 2).sum(axis=1)), np.sqrt((matrix[:, c].astype(float) ** 2).sum(axis=1))
            bound = np.ceil(norms[0][row[rest]] * norms[1][place[rest]] * (1 + 1e-9)).astype(np.int64)
            bounds[i, rest] = np.minimum(share[row[rest]] - 1, bound)
        most += bounds.sum(axis=0)
        for i, c in enumerate(cuts):  # each resolved partial score can rule a vector out
            can = most >= t[row]
            row, place, most, resolved, bounds = row[can], place[can], most[can], resolved[:, can], bounds[:, can]
            rest = np.flatnonzero(~resolved[i])
            self.passed["resolved"] += len(rest)
            for at in range(0, len(rest), 65536):
                some = rest[at : at + 65536]
                most[some] += np.einsum("ij,ij->i", queries[row[some], c], matrix[place[some], c]) - bounds[i, some]
        score = most
        good = score >= t[row]
        row, place, score = row[good], place[good], score[good]
        order = np.lexsort((rows[place], ids[place], -score, row))
        row, place, score = row[order], place[order], score[order]
        first = np.searchsorted(row, row)  # where the query's own begin
        top = np.arange(len(row)) - first < k
        return row[top], place[top], score[top]


_FOUND = ("query_row", "query_id", "row", "vec_id", "score")


def _pass(vectors: DataFrame, block: Block, k: int) -> DataFrame:
    """What one phase passes on."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, matrix in _matrices(batches):
            for columns in shared.value.lists(keys, ids, matrix, k):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_FOUND))

    return vectors.mapInArrow(run, ", ".join(f"{c} long" for c in _FOUND))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, most_numbers: int = 1 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of every query among all rows of ``vectors`` but its own.

    ``vectors`` has vec_id and embedding; queries are its rows where ``asks``. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. Vectors of other lengths than the query's are no
    candidates; empty vectors score 0 with each other. Ties go to the smaller id. Rows with one id are rows of their
    own: each asks for itself, and each is a candidate of the others. Scores must fit in 62 bits. No queries give no
    rows; other columns are ignored. ``most_numbers`` bounds the components of the queries in one block, which is two
    scans of the vectors.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    whole = materialise(integer_vectors(vectors, scale))
    asking = whole.where(asks)
    n = -(-int(asking.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()[0]) // most_numbers)
    found: list[DataFrame] = []
    for i in range(n):
        queries = sorted(asking.where(F.pmod(F.xxhash64("row"), F.lit(n)) == i).collect())  # about most_numbers numbers
        reached = _ranked(_pass(whole, Block(queries), k), k)
        cutoffs = reached.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
        safe = {r["query_row"]: r["score"] for r in cutoffs.collect()}
        best = _ranked(_pass(whole, Block(queries, safe), k), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        found.append(materialise(best) if n > 1 else best)
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def oracle_sql(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """The same in DuckDB over embeddings (vec_id, embedding)."""
    return f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.place <> c.place AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {k}
"""
