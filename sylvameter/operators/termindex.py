"""A kept term index: documents come and go, and a question reads the postings of its own terms alone.

The index is a folder of Parquet tables, one sub-folder for each generation (a batch of changes):

* ``postings`` (doc_id, term, tf) by bucket of the term, so that a question prunes to its terms' buckets;
* ``terms`` (term, df) and ``moments`` (doc_id, s0, s1, s2), both as differences that add up over generations;
* ``documents`` (doc_id, text, tags, project) for filters and excerpts, and ``gone`` (doc_id): rows of earlier generations
  with these ids are void;
* ``commits``: a generation counts from its row here on. One that failed before is written over by the next.

Scores are those of an index built anew from the documents that are left: idf(t) = ln(1 + n) - ln(1 + df) + 1, which is
L + c(t) with L = ln(1 + n) for all terms and c(t) = 1 - ln(1 + df). With a = 1 + ln tf the squared length of a document
is L^2 S(a^2) + 2 L S(a^2 c) + S(a^2 c^2). The three sums are its moments: a change of n costs nothing, and a change of a
term's df touches the documents in that term's postings alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sylvameter.functions import text as text_functions
from sylvameter.operators.search import EXCERPT, MOST_TERMS, narrowed, top
from sylvameter.session import exists, shared_path

_SCHEMAS = {
    "postings": "doc_id long, term string, tf long, generation long, bucket int",
    "terms": "term string, df long, generation long, bucket int",
    "moments": "doc_id long, s0 double, s1 double, s2 double, generation long",
    "documents": "doc_id long, text string, tags array<string>, project string, generation long",
    "gone": "doc_id long, generation long",
}
_COMMITS = "generation long, whole boolean, n_docs long"
_BY_BUCKET = ("postings", "terms")


@dataclass(frozen=True)
class State:
    """The generations that count and the number of documents."""

    generations: tuple[int, ...] = ()
    n_docs: int = 0


class TermIndex:
    """The index in ``folder``, which all executors share; made with the first change. ``buckets`` must stay the same.

    One writer at a time; readers see the last commit. Ids are longs; rows without one are left out.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 32) -> None:
        self.spark, self.buckets = spark, buckets
        self.folder = folder or shared_path(spark, "index")

    # --- tables

    def state(self) -> State:
        """What is committed; one small row for each change since the index was last written whole."""
        if not exists(self.spark, f"{self.folder}/commits"):
            return State()
        rows = sorted(self.spark.read.schema(_COMMITS).parquet(f"{self.folder}/commits").collect())
        since = max((r.generation for r in rows if r.whole), default=0)
        rows = [r for r in rows if r.generation >= since]
        return State(tuple(r.generation for r in rows), sum(r.n_docs for r in rows))

    def _read(self, name: str, generations: Sequence[int]) -> DataFrame:
        schema = StructType.fromDDL(_SCHEMAS[name])
        if not generations:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{name}/generation={g}" for g in generations]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _write(self, df: DataFrame, name: str, generation: int) -> DataFrame:
        path = f"{self.folder}/{name}/generation={generation}"
        columns = [c.split()[0] for c in _SCHEMAS[name].split(", ") if "generation" not in c]
        if name in _BY_BUCKET:
            keyed = df.withColumn("bucket", self._bucket(F.col("term"))).select(*columns)
            keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            df.select(*columns).write.mode("overwrite").parquet(path)
        return self._read(name, [generation])

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _live(self, name: str, generations: Sequence[int], void: DataFrame | None = None) -> DataFrame:
        """Rows of a table by doc_id whose document is still there; ``void`` are ids that go now."""
        gone = self._read("gone", generations)
        if void is not None:
            gone = gone.unionByName(void.select("doc_id", F.lit(1 << 62).alias("generation")))
        last = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("generation").alias("gone_in"))
        rows = self._read(name, generations)
        return rows.join(last, (F.col("doc_id") == F.col("gone_id")) & (F.col("generation") < F.col("gone_in")), "left_anti")

    def documents(self) -> DataFrame:
        """(doc_id, text, tags, project) of all documents."""
        return self._live("documents", self.state().generations).drop("generation")

    def vocabulary(self) -> DataFrame:
        """(term, df) of all terms."""
        return self._terms(self.state().generations)

    def _terms(self, generations: Sequence[int]) -> DataFrame:
        return self._read("terms", generations).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def __len__(self) -> int:
        return self.state().n_docs

    # --- changes

    def add(self, docs: DataFrame) -> None:
        """Put in ``docs`` (doc_id, text; tags and project if there): a document whose id is known is replaced.

        Of several rows with an id one counts, the greatest. A text without terms is indexed by its tags; a document
        without either counts as one and is never found.
        """
        tags = F.col("tags") if "tags" in docs.columns else F.lit(None)
        project = F.col("project") if "project" in docs.columns else F.lit(None)
        row = F.struct(F.col("text").cast("string").alias("text"), tags.cast("array<string>").alias("tags"), project.cast("string").alias("project"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row")).where("doc_id is not null")
        self._change(rows.groupBy("doc_id").agg(F.max("row").alias("row")).select("doc_id", "row.*"), None)

    def remove(self, ids: DataFrame) -> None:
        """Take out the documents with the ids of ``ids`` (doc_id); unknown ones are no error."""
        self._change(None, ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())

    def _change(self, new: DataFrame | None, ids: DataFrame | None) -> None:
        state = self.state()
        before, g = state.generations, max(state.generations, default=0) + 1
        new = self._write(self._read("documents", []) if new is None else new, "documents", g)
        there = self._live("documents", before).select("doc_id")
        gone = self._write(there.join(new if ids is None else ids, "doc_id", "left_semi"), "gone", g).select("doc_id")
        added = self._write(self._counted(new), "postings", g)
        lost = self._live("postings", before).join(gone, "doc_id", "left_semi")
        change = added.select("term", F.lit(1).alias("n")).union(lost.select("term", F.lit(-1).alias("n")))
        delta = self._write(change.groupBy("term").agg(F.sum("n").alias("df")).where("df <> 0"), "terms", g)
        # the moments of documents that stay, by the terms whose df is another now; then those of the new ones
        now = self._terms((*before, g)).select("term", F.col("df").alias("now"))
        touched = delta.join(now, "term", "left").select("term", "bucket", F.coalesce("now", F.lit(0)).alias("now"), (F.coalesce("now", F.lit(0)) - F.col("df")).alias("was"))
        stay = self._live("postings", before, gone).join(touched, ["bucket", "term"])
        new_c, old_c = _c(F.col("now")), _c(F.col("was"))
        changed = _moments(stay, [F.lit(0.0), new_c - old_c, new_c * new_c - old_c * old_c])
        fresh = _moments(added.join(now, "term"), [F.lit(1.0), new_c, new_c * new_c])
        self._write(changed.unionByName(fresh), "moments", g)
        self._commit(g, False, new.count() - gone.count())

    def compact(self) -> None:
        """Write what is left as one generation, moments anew; earlier generations count no more."""
        state = self.state()
        before, g = state.generations, max(state.generations, default=0) + 1
        self._write(self._live("documents", before), "documents", g)
        self._write(self._read("gone", []), "gone", g)
        postings = self._write(self._live("postings", before), "postings", g)
        now = self._write(self._terms(before), "terms", g).select("term", F.col("df").alias("now"))
        c = _c(F.col("now"))
        self._write(_moments(postings.join(now, "term"), [F.lit(1.0), c, c * c]), "moments", g)
        self._commit(g, True, state.n_docs)

    def _commit(self, generation: int, whole: bool, n_docs: int) -> None:
        self.spark.createDataFrame([(generation, whole, n_docs)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _counted(self, docs: DataFrame) -> DataFrame:
        own = text_functions.terms(F.col("text"))
        instead = text_functions.terms(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
        terms = docs.select("doc_id", own.alias("own"), instead.alias("instead"))
        rows = terms.select("doc_id", F.explode_outer(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("instead"))).alias("term"))
        return rows.where("term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))

    # --- questions

    def _asked(self, terms: Column, source: DataFrame) -> dict[str, int]:
        """Terms and their counts of one text; as many rows as it has distinct terms."""
        rows = source.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("tf")).collect()
        return {r.term: r.tf for r in rows}

    def _scores(self, state: State, asked: dict[str, int]) -> DataFrame:
        """(doc_id, score, matched): cosine with the asked terms, over documents that hold one of them."""
        names = self.spark.createDataFrame([(t,) for t in sorted(asked)], "term string").select(self._bucket(F.col("term")).alias("bucket"))
        buckets = sorted({r.bucket for r in names.distinct().collect()})
        mine = F.col("bucket").isin(buckets) & (F.col("term").isin(sorted(asked)) if len(asked) <= 500 else F.lit(True))
        df = {r.term: r.df for r in self._terms_of(state, mine, asked)}
        idf = {t: math.log((1 + state.n_docs) / (1 + n)) + 1 for t, n in df.items()}
        raw = {t: (1 + math.log(n)) * idf.get(t, 1.0) for t, n in asked.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        weights = self.spark.createDataFrame([(t, idf[t] * raw[t] / length) for t in sorted(idf)], "term string, weight double")
        held = self._live("postings", state.generations).where(mine).join(F.broadcast(weights), "term")
        found = held.groupBy("doc_id").agg(
            F.sum((1 + F.log("tf")) * F.col("weight")).alias("dot"),
            F.slice(F.array_sort(F.collect_set("term")), 1, MOST_TERMS).alias("matched"),
        )
        big = math.log(1 + state.n_docs)
        sums = self._live("moments", state.generations).groupBy("doc_id").agg(*[F.sum(s).alias(s) for s in ("s0", "s1", "s2")])
        norm = F.sqrt(big * big * F.col("s0") + 2 * big * F.col("s1") + F.col("s2"))
        return found.join(sums, "doc_id").select("doc_id", (F.col("dot") / norm).alias("score"), "matched").where("score > 0")

    def _terms_of(self, state: State, mine: Column, asked: dict[str, int]) -> list:
        rows = self._read("terms", state.generations).where(mine).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return [r for r in rows.collect() if r.term in asked]

    def _hits(self, state: State, found: DataFrame, k: int, narrow: dict) -> DataFrame:
        docs = self._live("documents", state.generations).drop("generation")
        kept = narrowed(docs, project_column="project", **narrow)
        if narrow:
            found = found.join(kept.select("doc_id"), "doc_id", "left_semi")
        best = top(found, k)
        return kept.join(F.broadcast(best), "doc_id").select("doc_id", "score", "matched", "tags", F.substring("text", 1, EXCERPT).alias("excerpt"))

    def search(self, query: str, k: int = 10, project: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
        """(doc_id, score, matched, tags, excerpt) of the k best documents, of ``project`` and with all ``tags`` if given."""
        state = self.state()
        asked = self._asked(text_functions.terms(F.lit(query)), self.spark.range(1))
        narrow = {n: v for n, v in (("project", project), ("tags", tags)) if v}
        return self._hits(state, self._scores(state, asked) if asked else self._nothing(), k, narrow)

    def unmatched(self, query: str) -> DataFrame:
        """(term) of the query that no document has."""
        asked = self.spark.range(1).select(F.explode(F.array_distinct(text_functions.terms(F.lit(query)))).alias("term"))
        return asked.join(self._terms(self.state().generations), "term", "left_anti")

    def similar_to(self, doc_id: int, k: int = 10) -> DataFrame:
        """The hits of the k documents most like one of the index, itself left out; none for an unknown id."""
        state = self.state()
        rows = self._live("postings", state.generations).where(F.col("doc_id") == doc_id).select("term", "tf").collect()
        found = self._scores(state, {r.term: r.tf for r in rows}) if rows else self._nothing()
        return self._hits(state, found.where(F.col("doc_id") != doc_id), k, {})

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "doc_id long, score double, matched array<string>")


def _c(df: Column) -> Column:
    return 1.0 - F.log(1.0 + df)


def _moments(rows: DataFrame, factors: list[Column]) -> DataFrame:
    a = 1.0 + F.log("tf")
    return rows.groupBy("doc_id").agg(*[F.sum(a * a * f).alias(f"s{i}") for i, f in enumerate(factors)])
