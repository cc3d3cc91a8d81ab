"""Term-weighted search: smoothed idf, sublinear term frequency, cosine scores, top k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvameter.functions import text as text_functions
from sylvameter.session import materialise

MOST_TERMS = 12
EXCERPT = 160


def term_counts(docs: DataFrame, text: Column | None = None, **settings) -> DataFrame:
    """(doc_id, term, tf). Terms are counted within each row before rows meet."""
    found = text_functions.terms(F.col("text") if text is None else text, **settings)
    # the outer explode keeps Spark from finding the terms a second time in a filter below it
    rows = docs.select("doc_id", F.explode_outer(found).alias("term")).where("term is not null")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf): ln((1 + n) / (1 + df)) + 1. ``counts`` has each term of a document once."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def vectors(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, term, w): (1 + ln tf) * idf, of unit length by document."""
    raw = counts.join(weights.select("term", "idf"), "term").withColumn("r", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "term", (F.col("r") / F.col("norm")).alias("w"))


def query_vector(spark: SparkSession, query: str, weights: DataFrame, **settings) -> DataFrame:
    """(term, qw) of a sentence; a term that no document has counts with idf 1 in the length of the vector."""
    one = spark.range(1).select(F.explode(text_functions.terms(F.lit(query), **settings)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    # the query side has a handful of rows: its terms prune the index and are broadcast
    known = weights.join(F.broadcast(one), "term", "right").select("term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0))).alias("r"))
    norm = known.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return known.crossJoin(F.broadcast(norm)).select("term", (F.col("r") / F.col("norm")).alias("qw"))


def scores(counts: DataFrame, weights: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, score, matched): cosine with the query, over documents that share a term.

    The lengths of documents come from one aggregation over the term table; only rows with query terms are scored.
    """
    joined = counts.join(weights.select("term", "idf"), "term").join(F.broadcast(query), "term", "left")
    r = (1 + F.log("tf")) * F.col("idf")
    return (
        joined.groupBy("doc_id")
        .agg(
            F.sum(r * F.col("qw")).alias("dot"), F.sqrt(F.sum(r * r)).alias("norm"),
            F.slice(F.array_sort(F.collect_set(F.when(F.col("qw").isNotNull(), F.col("term")))), 1, MOST_TERMS).alias("matched"),
        )
        .where("dot > 0")
        .select("doc_id", (F.col("dot") / F.col("norm")).alias("score"), "matched")
    )


def narrowed(docs: DataFrame, project: str | None = None, tags: Sequence[str] = (), project_column: str = "project_id", tags_column: str = "tags") -> DataFrame:
    """Documents of the project, or of none, that have all ``tags`` in any case."""
    if project:
        held = F.coalesce(F.col(project_column), F.lit(""))
        docs = docs.where((held == "") | (held == project))
    if tags:
        wanted = F.array(*[F.lit(t.lower()) for t in tags])
        docs = docs.where(F.size(F.array_except(wanted, F.transform(tags_column, lambda t: F.lower(t)))) == 0)
    return docs


def top(found: DataFrame, k: int = 10) -> DataFrame:
    """The k best, ties to the smaller doc_id; scores are compared to eight places."""
    return found.orderBy(F.desc(F.round("score", 8)), F.asc("doc_id")).limit(k)


def search(docs: DataFrame, query: str, k: int = 10, project: str | None = None, tags: Sequence[str] = (), **columns: str) -> DataFrame:
    """(doc_id, score, matched, excerpt) of the best documents; statistics are those of all ``docs`` (doc_id, text, ...)."""
    counts = materialise(term_counts(docs))  # read three times below
    weights = idf(counts, docs.count())
    asked = query_vector(docs.sparkSession, query, weights)
    kept = narrowed(docs, project, tags, **columns)
    ids = kept.select("doc_id")
    found = scores(counts.join(ids, "doc_id", "left_semi") if project or tags else counts, weights, asked)
    best = top(found, k)
    return kept.join(F.broadcast(best), "doc_id").select("doc_id", "score", "matched", F.substring("text", 1, EXCERPT).alias("excerpt"))


def unmatched(spark: SparkSession, query: str, counts: DataFrame) -> DataFrame:
    """(term) of the query that no document has."""
    asked = spark.range(1).select(F.explode(F.array_distinct(text_functions.terms(F.lit(query)))).alias("term"))
    return asked.join(counts.select("term").distinct(), "term", "left_anti")


def similar_to(docs: DataFrame, doc_id: int, k: int = 10) -> DataFrame:
    """(doc_id, score) of the documents most like one of them, itself left out."""
    counts = materialise(term_counts(docs))
    weights = idf(counts, docs.count())
    all_vectors = vectors(counts, weights)
    own = all_vectors.where(F.col("doc_id") == doc_id).select("term", F.col("w").alias("ow"))
    found = all_vectors.where(F.col("doc_id") != doc_id).join(own, "term").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("ow")).alias("score"))
    return top(found, k)


def index_text(tags: Column, project: Column, day: Column, canopy: Column) -> Column:
    """The text of an asset for the index: tags twice, project, date, canopy change."""
    words = F.array_join(F.transform(tags, lambda t: F.replace(t, F.lit("_"), F.lit(" "))), " ")
    change = F.when(canopy.isNotNull(), F.format_string("canopy %+.1f percent", canopy))
    return F.concat_ws(" ", words, words, project, day.cast("string"), change)


def best_match(left: DataFrame, right: DataFrame, on: str, distance: Column, order: Column) -> DataFrame:
    """The right row of least distance for each left row of one key, ties by ``order``."""
    window = Window.partitionBy(on).orderBy(distance, order)
    return left.join(right, on).withColumn("__r", F.row_number().over(window)).where("__r = 1").drop("__r")
