"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog, on DataFrame functions.

A line is boilerplate if ``least_sites`` distinct sites or more have it. Lines are known by two hashes (96 bits). Lines
that occur less often than that cannot qualify and go first, by a plain count. The occurrences of the rest feed one
HyperLogLog sketch of sites for each line, merged by aggregation: partial sketches meet, never rows. An estimate far
from the threshold decides; for one nearer than four standard errors the distinct sites are counted exactly. The first
occurrence of a boilerplate line, by doc_id and place, stays; all others are removed from their documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import own_exchange, unused
from sylvameter.session import materialise

_KEY = ["h1", "h2"]
#: The characters of the Unicode property White_Space but the line feed, which parts lines.
WHITE = "\t\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, text_key, site, pos, h1, h2 of each line that takes part, white space at its ends aside."""
    texts = docs.select(  # by itself: beside the generator a text would be hashed for each of its lines
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        _lines().alias("lines"),
    )
    rows = texts.select("doc_id", "text_key", "site", F.posexplode_outer("lines").alias("pos", "line"))
    line = F.btrim("line", F.lit(WHITE))
    kept = rows.where(line != "")
    return kept.select("doc_id", "text_key", "site", "pos", F.xxhash64(line).alias("h1"), F.crc32(line).alias("h2"))


def line_spread(docs: DataFrame, site: str = "source", least_sites: int = 5, lg_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(occurrences of frequent lines, boilerplate lines (h1, h2, n_sites, exact))."""
    found = _occurrences(docs, site)
    frequent = found.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") >= least_sites).drop("n")
    held = materialise(found.join(own_exchange(frequent, *_KEY), _KEY))
    sketches = held.groupBy(*_KEY).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = sketches.select(*_KEY, F.hll_sketch_estimate("sketch").alias("n_sites"))
    error = 1 + 4 * 1.04 / math.sqrt(2**lg_k)
    low, high = math.floor(least_sites / error), math.ceil(least_sites * error)
    spread = materialise(spread.where(F.col("n_sites") >= low))
    near = spread.where(F.col("n_sites") <= high)
    close = held.join(own_exchange(near.select(*_KEY), *_KEY), _KEY, "left_semi")
    pairs = own_exchange(close, *_KEY).groupBy(*_KEY, "site").agg(F.lit(1).alias("one"))  # added up before its own exchange
    exact = pairs.groupBy(*_KEY).agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= least_sites)
    sure = spread.where(F.col("n_sites") > high)
    return held, sure.withColumn("exact", F.lit(False)).unionByName(exact.withColumn("exact", F.lit(True)))


def removals(docs: DataFrame, site: str = "source", least_sites: int = 5) -> DataFrame:
    """doc_id, text_key, places: the line numbers (from 0, ascending) that each document loses."""
    held, boilerplate = line_spread(docs, site, least_sites)
    first = held.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    lines = boilerplate.join(first, _KEY).select(*_KEY, "first")
    again = held.join(own_exchange(lines, *_KEY), _KEY).where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("places"))


def _without(lines: Column, places: Column) -> Column:
    """``lines`` but those at ``places`` (ascending), in one step for each line."""
    before = F.concat(F.array(F.lit(-1)), F.slice(places, 1, F.size(places) - 1))
    stays, goes = F.lit(False), F.array(F.lit(True))
    marks = F.zip_with(places, before, lambda p, q: F.concat(F.array_repeat(stays, p - q - 1), goes))
    rest = F.array_repeat(stays, F.size(lines) - 1 - F.element_at(places, -1))
    zipped = F.arrays_zip(lines.alias("line"), F.flatten(F.concat(marks, F.array(rest))).alias("goes"))
    return F.transform(F.filter(zipped, lambda x: ~x["goes"]), lambda x: x["line"])


def remove_boilerplate(docs: DataFrame, site: str = "source", least_sites: int = 5) -> DataFrame:
    """``docs``, all columns, with ``text`` cleaned, and n_lines and n_removed beside.

    A null text stays null and has no lines removed; an empty one has one empty line. Blank lines always
    stay; any other takes part, however short. Repeated rows (same doc_id and text) are one document: they keep and lose the same
    lines. A null site is a site of its own; a null doc_id comes first among equals. Columns of any name are carried;
    where ``docs`` has an n_lines or n_removed, the new one gets an underscore. No rows give no rows.
    """
    names = {k: unused(k, docs.columns) for k in ("lost_id", "lost_key", "places", "n_lines", "n_removed")}
    lost = removals(docs, site, least_sites).select(
        F.col("doc_id").alias(names["lost_id"]), F.col("text_key").alias(names["lost_key"]), F.col("places").alias(names["places"])
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names["lost_id"])) & (F.xxhash64("text") == F.col(names["lost_key"]))
    joined, places = docs.join(lost, same, "left"), F.col(names["places"])
    cleaned = F.when(places.isNull(), F.col("text")).otherwise(F.array_join(_without(_lines(), places), "\n")).alias("text")
    return joined.select(
        *[cleaned if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long").alias(names["n_lines"]),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias(names["n_removed"]),
    )


def oracle_sql(least_sites: int = 5) -> str:
    """The same in DuckDB, for documents (doc_id, text, source): doc_id, text, n_lines, n_removed."""
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, site, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM texts
), bare AS (
  SELECT *, trim(line, {white}) AS core FROM lines
), known AS (
  SELECT core, arg_min(doc_id, (doc_id, pos)) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos
  FROM bare WHERE core <> ''
  GROUP BY 1 HAVING count(DISTINCT site) >= {least_sites}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, k.core IS NOT NULL AND NOT (l.doc_id = first_doc AND l.pos = first_pos) AS gone
  FROM bare l LEFT JOIN known k ON l.core = k.core
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed
FROM marked GROUP BY doc_id
"""
