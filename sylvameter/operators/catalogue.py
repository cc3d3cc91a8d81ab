"""Faceted catalogue: conjunctive filters, facet counts with a facet's own filter lifted, pages and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most rows of one page.
PAGE_LIMIT = 200


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def matches_text(needle: str | None, name: str, tags: str | None = None) -> Column:
    """Case-folded substring of a name or of any tag; no needle matches all rows."""
    if not needle:
        return F.lit(True)
    low = needle.lower()
    found = F.lower(F.col(name)).contains(low)
    if tags:
        found = found | F.coalesce(F.exists(F.col(tags), lambda t: F.lower(t).contains(low)), F.lit(False))
    return found


def filter_catalogue(
    df: DataFrame, equal: Mapping[str, object] | None = None, tag: str | None = None, text: str | None = None,
    name: str = "public_id", tags: str = "tags",
) -> DataFrame:
    """Rows that meet every given condition; a condition that is empty or None is no filter."""
    conditions = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v not in (None, "")]
    if tag:
        conditions.append(F.array_contains(F.col(tags), tag))
    if text:
        conditions.append(matches_text(text, name, tags if tags in df.columns else None))
    return df.where(_all(conditions))


def listing(df: DataFrame, columns: Sequence[str], tags: str = "tags") -> DataFrame:
    """The listed columns; null tags become an empty array."""
    empty = F.array().cast("array<string>")
    return df.select(*[F.coalesce(F.col(c), empty).alias(c) if c == tags else F.col(c) for c in columns])


def page(df: DataFrame, order: Sequence[Column], limit: int = 60, offset: int = 0) -> DataFrame:
    """One page in a total order; the limit is held to 1..PAGE_LIMIT and the offset to 0 or more."""
    limit, offset = max(1, min(PAGE_LIMIT, limit)), max(0, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_totals(df: DataFrame, limit: int = 60, offset: int = 0) -> DataFrame:
    """One row: total, returned and has_more of that page, from a count alone."""
    limit, offset = max(1, min(PAGE_LIMIT, limit)), max(0, offset)
    total = df.agg(F.count("*").alias("total"))
    returned = F.greatest(F.least(F.col("total") - offset, F.lit(limit)), F.lit(0)).cast("long")
    return total.select("total", returned.alias("returned"), (F.lit(offset) + returned < F.col("total")).alias("has_more"))


def facet_counts(df: DataFrame, chosen: Mapping[str, object | None]) -> DataFrame:
    """(axis, value, n): for every axis, the counts of its values under all filters but its own.

    One pass: each row becomes one row for each axis whose other filters it meets, and counts combine on the map side.
    Null and empty values are not counted.
    """
    axes = list(chosen)
    meets = {a: F.lit(True) if chosen[a] in (None, "") else F.coalesce(F.col(a) == F.lit(chosen[a]), F.lit(False)) for a in axes}
    rows = F.array(
        *[
            F.when(_all([meets[b] for b in axes if b != a]), F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")))
            for a in axes
        ]
    )
    long = df.select(F.explode_outer(rows).alias("r")).select("r.axis", "r.value")
    return long.where("value is not null and value <> ''").groupBy("axis", "value").agg(F.count("*").alias("n"))


def facets_ordered(counts: DataFrame) -> DataFrame:
    """Facet values of each axis by falling count and then value, as arrays of structs."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value")))
    return counts.groupBy("axis").agg(F.transform(order, lambda x: F.struct(x["value"], (-x["k"]).alias("n"))).alias("values"))


def tally(df: DataFrame, *axes: str) -> DataFrame:
    """(axis, value, n) over all rows, for each of ``axes``."""
    return facet_counts(df, dict.fromkeys(axes))


def tag_frequency(df: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n): how often each tag occurs, repeats within a row included."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def first_per_group(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each group in ``order``; Spark limits groups before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def stride(df: DataFrame, number: str, every: int, phase: int = 0) -> DataFrame:
    """Every ``every``-th row by a running number, so that strides of other phases have no row in common."""
    return df.where(F.pmod(F.col(number), F.lit(every)) == phase)


def nearest_rank(df: DataFrame, value: str, quantiles: Sequence[float], *groups: str) -> DataFrame:
    """Nearest-rank percentiles: the value at place round(q * n) (half to even, at least 1) in rising order, by group.

    Values are counted before they are ranked, so equal values meet once; the running sum is by group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    rising = Window.partitionBy(*groups).orderBy(value)
    total = Window.partitionBy(*groups)
    ranked = counts.withColumn("upto", F.sum("n").over(rising)).withColumn("all", F.sum("n").over(total))
    def at(q: float) -> Column:
        place = F.greatest(F.bround(F.lit(q) * F.col("all"), 0), F.lit(1.0))
        return F.min(F.when(F.col("upto") >= place, F.col(value))).alias(f"p{round(q * 100)}")

    return ranked.groupBy(*groups).agg(*[at(q) for q in quantiles])
