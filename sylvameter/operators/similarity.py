"""Which documents are alike: a cosine join of all documents with a threshold, by prefix filter.

Terms have one order for all documents, the rarest first. A document's prefix are its leading terms, up to where what
follows is shorter than the threshold. Two documents whose cosine reaches the threshold share a term of both prefixes:
otherwise all that they share lies in the rest of one of them, which is too short. So documents meet by rare terms alone.

Documents with the same term counts are one class. Classes are joined, not documents: a group of copies of any size is
one row there, and only its first members enter a list of the k most similar.

Documents are dealt to blocks by a hash of their id, and a block is one row of arrays: its terms as hashes, and for each
document places in them. Every block meets every other one as arrays. Of two documents whose first common term has weights
w and v and is followed by lengths r and s, the cosine is w v + r s at most, which rules out most that share a rare term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvameter.functions import text as text_functions
from sylvameter.session import materialise, ship

#: Characters of a block of documents, and pairs of leading terms that are looked at at once.
BLOCK, AT_ONCE = 44_000_000, 2_000_000
#: Slack of sums of floating-point numbers.
_SLACK = 1e-9
#: That of bounds, which may let pairs pass and must lose none: they come from differences of long running sums.
_LOOSE = 1e-6


def prefixes(unit: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, term) of the leading terms of unit vectors (doc_id, term, w), the rarest first."""
    rest = Window.partitionBy("doc_id").orderBy(F.asc("df"), F.asc("term")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = unit.join(weights.select("term", "df"), "term").withColumn("rest", F.sum(F.col("w") * F.col("w")).over(rest))
    return following.where(F.col("rest") >= threshold * threshold - _SLACK).select("doc_id", "term")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) by blocks: ids, ends, terms, places and tf of each document's terms, n by term, h1 and h2 by document."""
    n_blocks = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    hashes = F.transform(text_functions.terms(F.col("text")), lambda t: F.xxhash64(t))
    rows = docs.select("doc_id", hashes.alias("h")).where(F.size("h") > 0)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("block")
    arrays = "ids array<bigint>, ends array<int>, terms array<bigint>, places array<int>, tf array<int>, n array<bigint>, h1 array<bigint>, h2 array<bigint>"
    return rows.select(block, "doc_id", "h").groupBy("block").applyInArrow(_pack, f"block int, {arrays}")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(rows: pa.Table) -> pa.Table:
    h = rows.column("h").combine_chunks()
    ids, doc = np.unique(np.asarray(rows.column("doc_id")), return_inverse=True)
    terms, place = np.unique(np.asarray(h.flatten()), return_inverse=True)
    place += np.repeat(doc * len(terms), np.asarray(h.value_lengths()))
    place.sort()  # in place, as this is the largest array
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    tf = np.diff(starts, append=len(place))
    doc, place = np.divmod(place[starts], len(terms))
    ends = np.searchsorted(doc, np.arange(len(ids) + 1))
    entry = _mixed(terms[place].view(np.uint64) + tf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h1, h2 = np.bitwise_xor.reduceat(entry, ends[:-1]), np.add.reduceat(_mixed(entry + np.uint64(1)), ends[:-1])
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    out = {"ids": (ids, longs), "ends": (ends, ints), "terms": (terms, longs), "places": (place, ints), "tf": (tf, ints), "n": (np.bincount(place), longs), "h1": (h1.view(np.int64), longs), "h2": (h2.view(np.int64), longs)}
    lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind.value_type, safe=False)) for k, (v, kind) in out.items()}
    return pa.table({"block": rows.column("block").slice(0, 1).combine_chunks(), **lists})


def classes(blocks: DataFrame) -> DataFrame:
    """(block, doc_id, class_id): the smallest doc_id with the same terms, as often. By two 64-bit sums over the terms."""
    by_doc = blocks.select("block", F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), "h1", "h2")))
    by_doc = by_doc.toDF("block", "doc_id", "h1", "h2")
    least = by_doc.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"))
    return by_doc.join(least.hint("merge"), ["h1", "h2"]).select("block", "doc_id", "class_id")


def linked_classes(blocks: DataFrame, n_docs: int, membership: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b: the pairs of classes whose cosine is at least ``threshold``."""
    by_term = blocks.select("block", F.inline(F.arrays_zip("terms", "n"))).toDF("block", "term", "n")
    df = by_term.groupBy("term").agg(F.sum("n").alias("df"))
    known = by_term.select("block", "term").join(df.hint("merge"), "term").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("t"))
    firsts = membership.where("doc_id = class_id").groupBy("block").agg(F.collect_list("doc_id").alias("firsts"))
    small = known.select("block", F.col("t.df").alias("df")).join(firsts.hint("merge"), "block")
    ready = materialise(blocks.select("block", "ids", "ends", "terms", "places", "tf").join(small.hint("merge"), "block"))
    numbers = [r[0] for r in ready.select("block").collect()]
    later = F.filter(F.array(*[F.lit(n) for n in numbers]).cast("array<int>"), lambda x: x >= F.col("block"))
    before = F.filter(F.array(*[F.lit(n) for n in numbers]).cast("array<int>"), lambda x: x <= F.col("block"))
    left = ready.select(F.col("block").alias("i"), F.explode(later).alias("j"), *ready.columns[1:])
    right = ready.select(F.explode(before).alias("i"), F.col("block").alias("j"), *ready.columns[1:])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return _links(_Block(a, n_docs, threshold), _Block(b, n_docs, threshold), threshold, a.column("i")[0] == b.column("j")[0])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "a long, b long, score double")


class _Block:
    """The classes of a block: unit vectors as places and weights, and their leading terms, the rarest first."""

    def __init__(self, rows: pa.Table, n_docs: int, threshold: float) -> None:
        take = {c: np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("ids", "ends", "terms", "places", "tf", "df", "firsts")}
        self.terms, df = take["terms"], take["df"]
        lengths, first = np.diff(take["ends"]), np.isin(take["ids"], take["firsts"])
        kept = np.repeat(first, lengths)
        self.ids, self.ends = take["ids"][first], np.concatenate([[0], lengths[first].cumsum()])
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((self.terms, df))] = np.arange(len(df))
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), lengths[first])
        places = take["places"][kept]
        order = np.argsort(doc * np.int64(len(df)) + rank[places])
        self.places = places[order]
        self.w = (1 + np.log(take["tf"][kept][order])) * (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0)[self.places]
        del kept, places, order
        self.w /= np.sqrt(np.bincount(doc, self.w * self.w, len(self.ids)))[doc]
        w2 = self.w * self.w
        upto = w2.cumsum()
        rest = upto[self.ends[1:] - 1][doc] - upto + w2
        lead = rest >= threshold * threshold - _LOOSE
        self.lead = doc[lead], self.places[lead], self.w[lead], np.sqrt(np.maximum(rest - w2, 0) + _SLACK)[lead]


def _links(a: _Block, b: _Block, threshold: float, same: bool) -> pa.Table:
    """(a, b, score) of the documents of two blocks that reach the threshold."""
    at = np.minimum(np.searchsorted(a.terms, b.terms), len(a.terms) - 1)
    there = np.where(a.terms[at] == b.terms, at, len(a.terms))  # one place more: terms that a has not
    pairs = _candidates(a.lead, (b.lead[0], there[b.lead[1]], *b.lead[2:]), len(a.terms), len(b.ids), threshold, same)
    x, y = np.divmod(pairs, len(b.ids))
    places, dense, scores = there[b.places], np.zeros(len(a.terms) + 1), np.empty(len(pairs))
    for start, end in _runs(x):
        own = slice(a.ends[x[start]], a.ends[x[start] + 1])
        dense[a.places[own]] = a.w[own]
        lows, highs = b.ends[y[start:end]], b.ends[y[start:end] + 1]
        sizes = highs - lows
        begins = sizes.cumsum() - sizes
        cells = np.arange(sizes.sum()) + np.repeat(lows - begins, sizes)
        scores[start:end] = np.add.reduceat(dense[places[cells]] * b.w[cells], begins)
        dense[a.places[own]] = 0.0
    kept = scores >= threshold - _SLACK
    one, two = a.ids[x[kept]], b.ids[y[kept]]
    return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two), "score": scores[kept]})


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the equal neighbours of an ascending array."""
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True)) if len(x) else []


def _candidates(left: tuple, right: tuple, n_terms: int, n_right: int, threshold: float, same: bool) -> np.ndarray:
    """Pairs (left document * n_right + right document), ascending, that share a leading term and whose bound reaches the threshold."""
    (da, ta, wa, ra), (db, tb, wb, rb) = (tuple(c[np.argsort(s[1], kind="stable")] for c in s) for s in (left, right))
    low = np.searchsorted(tb, ta)
    many = np.where(ta < n_terms, np.searchsorted(tb, ta, side="right") - low, 0)
    upto, found = many.cumsum(), []
    start = 0
    while start < len(ta):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + AT_ONCE, side="right")))
        i = np.repeat(np.arange(start, end), many[start:end])
        j = np.arange(len(i)) - np.repeat(many[start:end].cumsum() - many[start:end], many[start:end]) + low[i]
        kept = wa[i] * wb[j] + ra[i] * rb[j] >= threshold - _LOOSE
        kept &= (da[i] < db[j]) if same else True
        found.append(np.unique(da[i[kept]].astype(np.int64) * n_right + db[j[kept]]))
        start = end
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def similar_documents(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, n_links) of all documents with terms, and the links (a, b, score) between their classes.

    ``docs`` has doc_id and text. n_links counts the other documents whose cosine with this one is at least
    ``threshold``, those of its own class included. Documents without a term are like none and left out.
    """
    ship(docs.sparkSession)
    blocks = materialise(packed(docs))
    membership = materialise(classes(blocks))
    links = materialise(linked_classes(blocks, docs.count(), membership, threshold))
    sizes = membership.groupBy("class_id").agg(F.count("*").alias("size"))
    both = links.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(links.select("b", "a"))
    other = both.join(sizes.withColumnsRenamed({"class_id": "other", "size": "there"}), "other").groupBy("class_id").agg(F.sum("there").alias("there"))
    n_links = sizes.join(other, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("there", F.lit(0))).alias("n_links"))
    return membership.join(n_links, "class_id").select("doc_id", "class_id", "n_links"), links


def most_similar(docs: DataFrame, threshold: float = 0.8, k: int = 10) -> DataFrame:
    """(doc_id, rank, other_id, score): the k documents most like each one, ties to the smaller id; see similar_documents."""
    found, links = similar_documents(docs, threshold)
    found = materialise(found)
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("doc_id"))
    first = found.select("class_id", "doc_id", place.alias("r")).where(F.col("r") <= k + 1).select("class_id", F.col("doc_id").alias("other_id"))
    same = first.select("class_id", "other_id", F.lit(1.0).alias("score"))
    both = links.select(F.col("a").alias("class_id"), F.col("b").alias("to"), "score").union(links.select("b", "a", "score"))
    there = both.join(first.withColumnRenamed("class_id", "to"), "to").select("class_id", "other_id", "score")
    best = Window.partitionBy("class_id").orderBy(F.desc(F.round("score", 8)), "other_id")
    lists = same.union(there).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    each = found.select("doc_id", "class_id").join(lists, "class_id").where("doc_id <> other_id")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("r"))
    return each.select("doc_id", rank.alias("rank"), "other_id", "score").where(F.col("rank") <= k)
