"""Registered queries: catalogue, facets, summaries and timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvameter.operators import catalogue as ops
from sylvameter.operators import timeline
from sylvameter.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _captures(spark: SparkSession, d: str) -> DataFrame:
    """Orders as captures: a customer is a project, the price the measure, the status the decision."""
    status = F.col("o_orderstatus")
    decision = F.when(status == "F", "VERIFIED_PASS").when(status == "P", "QUARANTINE_FRAUD").otherwise("REVIEW_AMBIGUOUS")
    return _orders(spark, d).select(
        F.col("o_custkey").alias("project"), F.to_date("o_orderdate").alias("day"), decision.alias("decision"), F.col("o_totalprice").alias("measure")
    )


def catalogue_page(spark: SparkSession, d: str) -> DataFrame:
    found = ops.filter_catalogue(_orders(spark, d), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None})
    rows = ops.listing(found, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"])
    return ops.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], limit=60, offset=20)


def catalogue_total(spark: SparkSession, d: str) -> DataFrame:
    return ops.page_totals(ops.filter_catalogue(_orders(spark, d), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}), 60, 20)


def facet_lifted(spark: SparkSession, d: str) -> DataFrame:
    return ops.facet_counts(_orders(spark, d), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


def facet_segments(spark: SparkSession, d: str) -> DataFrame:
    joined = _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ops.facet_counts(joined, {"o_orderstatus": "O", "o_orderpriority": None, "c_mktsegment": "BUILDING"})


def substring_or_tag(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("tags", F.split("p_type", " "))
    return ops.filter_catalogue(part, text="RING", name="p_name").select("p_partkey", "p_name", "p_type")


def tag_member(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("tags", F.split("p_name", " "))
    return ops.filter_catalogue(part, tag="red").select("p_partkey", "p_name")


def canned_verified(spark: SparkSession, d: str) -> DataFrame:
    found = ops.filter_catalogue(_orders(spark, d), {"o_orderstatus": "F"}).where("o_totalprice > 200000")
    return ops.page(found.select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.asc("o_orderkey")], limit=50)


def canned_quarantine(spark: SparkSession, d: str) -> DataFrame:
    found = ops.filter_catalogue(_orders(spark, d), {"o_orderstatus": "P"})
    return ops.page(found.select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.asc("o_orderkey")], limit=20)


def contradiction_count(spark: SparkSession, d: str) -> DataFrame:
    both = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").agg(F.count_if(both).alias("contradictions"), F.count("*").alias("total"))


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    joined = _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.agg(
        F.count("*").alias("total"),
        F.countDistinct("o_custkey").alias("projects"),
        F.countDistinct("o_orderpriority").alias("phases"),
        F.countDistinct("c_mktsegment").alias("domains"),
        F.min(F.to_date("o_orderdate")).alias("first_day"),
        F.max(F.to_date("o_orderdate")).alias("last_day"),
        F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).alias("contradictions"),
    )


def corpus_tallies(spark: SparkSession, d: str) -> DataFrame:
    return ops.tally(_orders(spark, d), "o_orderstatus", "o_orderpriority")


def tag_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ops.tag_frequency(table(spark, d, "part").select(F.split("p_name", " ").alias("tags")))


def first_per_project(spark: SparkSession, d: str) -> DataFrame:
    first = ops.first_per_group(_orders(spark, d), "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", "o_totalprice")


def latest_per_project(spark: SparkSession, d: str) -> DataFrame:
    last = ops.first_per_group(_orders(spark, d), "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")])
    return last.select("o_custkey", "o_orderkey", "o_totalprice")


def stride_selection(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    picked = [ops.stride(events, "event_id", 10, phase).select("event_id", F.lit(what).alias("intervention")) for phase, what in ((0, "fault"), (5, "low_sun"))]
    return picked[0].unionByName(picked[1])


def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return ops.nearest_rank(table(spark, d, "lineitem"), "l_extendedprice", (0.5, 0.95, 0.99), "l_returnflag")


def epoch_assignment(spark: SparkSession, d: str) -> DataFrame:
    found = timeline.assign_epochs(_captures(spark, d))
    return found.groupBy(F.coalesce("epoch", F.lit("UNPLACED")).alias("epoch")).agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    return timeline.epoch_report(timeline.assign_epochs(_captures(spark, d)))


def epoch_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _epochs(spark, d).select(
        "project", "epoch", "nominal", "observed", "verified", "quarantined", F.round("mean_measure", 4).alias("mean_measure"), "first_day", "last_day", "status"
    )


def epoch_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _epochs(spark, d).where("status <> 'FULL'").select("project", "epoch", "nominal", "observed", F.col("shortfall").cast("long"), "status")


def timeline_status(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project"))
    out = timeline.build_timelines(projects, _captures(spark, d))
    return out.select(
        "project", F.col("total").cast("long"), F.col("placed").cast("long"), F.round("coverage_pct", 4).alias("coverage_pct"),
        F.round("capped_coverage_pct", 4).alias("capped_coverage_pct"), F.col("gaps").cast("long"), F.col("longest_gap_months").cast("long"), "state",
    )


def true_longest_gap(spark: SparkSession, d: str) -> DataFrame:
    return timeline.longest_true_gap(_captures(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        catalogue_page, catalogue_total, facet_lifted, facet_segments, substring_or_tag, tag_member, canned_verified, canned_quarantine,
        contradiction_count, corpus_summary, corpus_tallies, tag_frequency, first_per_project, latest_per_project, stride_selection,
        percentile_nearest_rank, epoch_assignment, epoch_coverage, epoch_gaps, timeline_status, true_longest_gap,
    )
}

_MONTHS = "((year({1}) - year({0})) * 12 + month({1}) - month({0}) - CASE WHEN day({1}) < day({0}) THEN 1 ELSE 0 END)"
_PLACED = f"""
captures AS (
  SELECT o_custkey AS project, o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, o_totalprice AS m,
         CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS start FROM orders
), schedule(ord, epoch, months) AS (
  VALUES (0, 'baseline_month_0', 0), (1, 'progress_month_6', 6), (2, 'progress_month_18', 18), (3, 'certified_year_3', 36)
), distances AS (
  SELECT c.*, ord, epoch, abs({_MONTHS.format("CAST(start + to_months(months) AS DATE)", "d")}) AS dist FROM captures c, schedule
), placed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY dist, ord) AS r FROM distances) WHERE r = 1
), epochs AS (
  SELECT p.project, p.start, p.total, s.ord, s.epoch, CAST(p.start + to_months(s.months) AS DATE) AS nominal, count(a.o_orderkey) AS observed,
         count(*) FILTER (a.s = 'F') AS verified, count(*) FILTER (a.s = 'P') AS quarantined, avg(a.m) AS mean_measure, min(a.d) AS first_day, max(a.d) AS last_day
  FROM (SELECT project, start, count(*) AS total FROM captures GROUP BY ALL) p CROSS JOIN schedule s
  LEFT JOIN placed a ON a.project = p.project AND a.epoch = s.epoch AND a.dist <= 2 GROUP BY ALL
), judged AS (
  SELECT *, CASE WHEN observed >= 3 THEN 'FULL' WHEN observed > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status, greatest(3 - observed, 0) AS shortfall FROM epochs
)"""
_FILTER = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"

ORACLE_SQL: dict[str, str] = {
    "catalogue_page": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate FROM orders WHERE {_FILTER} ORDER BY o_orderdate DESC, o_orderkey LIMIT 60 OFFSET 20",
    "catalogue_total": f"SELECT total, greatest(least(total - 20, 60), 0)::BIGINT AS returned, 20 + greatest(least(total - 20, 60), 0) < total AS has_more FROM (SELECT count(*) AS total FROM orders WHERE {_FILTER})",
    "facet_lifted": """
SELECT 'o_orderstatus' AS axis, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""",
    "facet_segments": """
WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'o_orderstatus' AS axis, o_orderstatus AS value, count(*) AS n FROM j WHERE c_mktsegment = 'BUILDING' GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM j WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING' GROUP BY 2
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM j WHERE o_orderstatus = 'O' GROUP BY 2""",
    "substring_or_tag": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')",
    "tag_member": "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red')",
    "canned_verified": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "canned_quarantine": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "contradiction_count": "SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS contradictions, count(*) AS total FROM lineitem",
    "corpus_summary": """
SELECT count(*) AS total, count(DISTINCT o_custkey) AS projects, count(DISTINCT o_orderpriority) AS phases, count(DISTINCT c_mktsegment) AS domains,
       CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
       count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS contradictions
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "corpus_tallies": "SELECT 'o_orderstatus' AS axis, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "tag_frequency": "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1",
    "first_per_project": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "latest_per_project": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "stride_selection": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'fault' ELSE 'low_sun' END AS intervention FROM events WHERE event_id % 10 IN (0, 5)",
    "percentile_nearest_rank": """
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice))
SELECT l_returnflag, max(v) FILTER (k = greatest(round_even(0.5e0 * n, 0), 1)) AS p50, max(v) FILTER (k = greatest(round_even(0.95e0 * n, 0), 1)) AS p95,
       max(v) FILTER (k = greatest(round_even(0.99e0 * n, 0), 1)) AS p99 FROM r GROUP BY 1""",
    "epoch_assignment": f"WITH {_PLACED} SELECT CASE WHEN dist <= 2 THEN epoch ELSE 'UNPLACED' END AS epoch, count(*) AS n, count(DISTINCT project) AS projects FROM placed GROUP BY 1",
    "epoch_coverage": f"WITH {_PLACED} SELECT project, epoch, nominal, observed, verified, quarantined, round(mean_measure, 4) AS mean_measure, first_day, last_day, status FROM judged",
    "epoch_gaps": f"WITH {_PLACED} SELECT project, epoch, nominal, observed, shortfall::BIGINT AS shortfall, status FROM judged WHERE status <> 'FULL'",
    "timeline_status": f"""
WITH {_PLACED}, report AS (
  SELECT project, max(total) AS total, sum(observed)::BIGINT AS placed, least(sum(observed) / 12e0, 1) * 100 AS c, sum(least(observed, 3)) / 12e0 * 100 AS cc,
         count(*) FILTER (status <> 'FULL') AS gaps, coalesce(max({_MONTHS.format("start", "nominal")}) FILTER (status <> 'FULL'), 0) AS longest
  FROM judged GROUP BY 1
)
SELECT c_custkey AS project, coalesce(total, 0)::BIGINT AS total, coalesce(placed, 0)::BIGINT AS placed, round(coalesce(c, 0), 4) AS coverage_pct, round(coalesce(cc, 0), 4) AS capped_coverage_pct,
       coalesce(gaps, 0)::BIGINT AS gaps, coalesce(longest, 0)::BIGINT AS longest_gap_months,
       CASE WHEN total IS NULL THEN 'NO_EVIDENCE' WHEN gaps = 0 THEN 'ON_SCHEDULE' ELSE 'GAPS_DETECTED' END AS state
FROM customer LEFT JOIN report ON project = c_custkey""",
    "true_longest_gap": """
WITH g AS (SELECT o_custkey AS project, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), CAST(o_orderdate AS DATE)) AS gap FROM orders)
SELECT project, max(gap)::BIGINT AS longest_gap_days FROM g GROUP BY 1""",
}
