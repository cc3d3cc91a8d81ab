"""Registered queries: term search, compiled sentences and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvameter.functions import text as text_functions
from sylvameter.operators import nlquery, search, validation
from sylvameter.operators.termindex import TermIndex
from sylvameter.operators.validation import Rule
from sylvameter.session import spread
from sylvameter.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_ASKED = "the erin thnt ble clown of tree forest zzzunseen"
_ANCHOR = 1


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def token_synonyms(spark: SparkSession, d: str) -> DataFrame:
    found = F.explode(text_functions.terms(F.concat_ws(" ", F.col("text"), F.lit("Forest river photo the drone"))))
    return _docs(spark, d).select(found.alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    counts = search.term_counts(_docs(spark, d))
    return search.idf(counts, _docs(spark, d).count()).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_top_k(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_docs(spark, d), _ASKED, 10).select("doc_id", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched"))


def tfidf_similar(spark: SparkSession, d: str) -> DataFrame:
    return search.similar_to(_docs(spark, d), _ANCHOR, 10).select("doc_id", F.round("score", 6).alias("score"))


def tfidf_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return search.unmatched(spark, _ASKED, search.term_counts(_docs(spark, d)))


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("tags", F.array(F.upper("lang")))
    found = search.search(docs, _ASKED, 10, project="src3", tags=["EN"], project_column="source")
    return found.select("doc_id", F.round("score", 6).alias("score"))


def _changed_index(spark: SparkSession, d: str) -> TermIndex:
    """All documents in two batches of languages; then those of one language with more words, and a source taken out."""
    docs = _docs(spark, d).withColumn("project", F.col("source"))
    first = F.coalesce("lang", F.lit("")).isin("en", "fr")
    index = TermIndex(spark, buckets=8)
    index.add(docs.where(first))
    index.add(docs.where(~first))
    index.add(docs.where("lang = 'de'").withColumn("text", F.concat_ws(" ", "text", F.lit("Forest clown by the river"))))
    index.remove(docs.where("source = 'src3'"))
    return index


def index_search(spark: SparkSession, d: str) -> DataFrame:
    found = _changed_index(spark, d).search(_ASKED, 10)
    return found.select("doc_id", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched"))


def index_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _changed_index(spark, d).vocabulary()


def index_similar(spark: SparkSession, d: str) -> DataFrame:
    """Asked of the index after it was written whole again."""
    index = _changed_index(spark, d)
    index.compact()
    return index.similar_to(_ANCHOR, 10).select("doc_id", F.round("score", 6).alias("score"))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    """Orders under the names of the catalogue."""
    o = table(spark, d, "orders")
    status, pri = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("asset_id"),
        F.concat(F.lit("KEN-"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")).alias("esg_project_id"),
        F.when(status == "F", "VERIFIED_PASS").when(status == "P", "QUARANTINE_FRAUD").otherwise("REVIEW_AMBIGUOUS").alias("jev_triage_decision"),
        F.when(pri == "1-URGENT", "baseline_month_0").when(pri == "2-HIGH", "progress_month_6").when(pri == "3-MEDIUM", "progress_month_18").otherwise("certified_year_3").alias("milestone_phase"),
        F.when(F.col("o_orderkey") % 2 == 0, "mangrove_restoration").otherwise("reforestation").alias("sustainability_domain"),
        (F.col("o_totalprice") / 1000).alias("canopy_delta_pct"),
        (F.col("o_custkey") % 101).alias("jev_confidence_score"),
        (F.col("o_orderkey") % 101).cast("double").alias("sift_inlier_ratio"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("capture_timestamp"),
    )


_ASSETS = """
WITH assets AS (
  SELECT o_orderkey AS asset_id, 'KEN-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS project, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 2 AS odd,
         o_totalprice / 1000 AS canopy, o_custkey % 101 AS conf, o_orderkey % 101 AS inlier, CAST(o_orderdate AS DATE) AS d FROM orders
) SELECT asset_id FROM assets WHERE """
#: Sentences with the condition that a reader would write for them.
SENTENCES: dict[str, tuple[str, str]] = {
    "nl_compiled_1": ("canopy growth between 20 and 40 percent", "canopy BETWEEN 20 AND 40"),
    "nl_compiled_2": ("quarantined photos with confidence under 60 percent", "s = 'P' AND conf <= 60"),
    "nl_compiled_3": ("month 18 progress assets", "p = '3-MEDIUM'"),
    "nl_compiled_4": ("verified mangrove assets for KEN-042 with canopy over 30 percent", "s = 'F' AND odd = 0 AND project = 'KEN-042' AND canopy >= 30"),
    "nl_compiled_5": ("baseline reforestation evidence with inlier at least 85 since 1999", "p = '1-URGENT' AND odd = 1 AND inlier >= 85 AND d >= DATE '1999-01-01'"),
    "nl_compiled_6": ("review of certified forest plots until 1997", "s = 'O' AND p IN ('4-NOT SPECIFIED', '5-LOW') AND odd = 1 AND d <= DATE '1997-12-31'"),
}


def _compiled(sentence: str) -> Query:
    return lambda spark, d: nlquery.run_query(_assets(spark, d), sentence).select("asset_id")


def search_router(spark: SparkSession, d: str) -> DataFrame:
    """The structured way of the router, carried out; the way taken is a column."""
    assets = _assets(spark, d)
    way, rows = nlquery.route(assets, "verified assets with canopy over 450", lambda s: assets.limit(0))
    return rows.select("asset_id", F.lit(way).alias("way"))


ORDER_RULES = (
    Rule("o_orderstatus", True, allowed=("F", "O")),
    Rule("o_orderpriority", True, r"^[1-4]-[A-Z ]+$"),
    Rule("o_totalprice", low=2000, high=450000),
    Rule("o_orderdate", True, date=True),
)


def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    found = validation.validate(table(spark, d, "orders"), ORDER_RULES)
    return found.where("first_problem is not null").groupBy("first_problem").agg(F.count("*").alias("n"), F.sum(F.size("problems")).alias("problems"))


def schema_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    wanted = nation.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("digest"))
    existing = nation.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 5).cast("string").alias("digest"))
    return validation.bootstrap(wanted, existing)


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1).alias("host"), text_functions.parent_folder(url).alias("folder"),
        text_functions.layer_reference(F.regexp_extract(url, r"^[a-z]+://[^/]+/([^?#]*)", 1)).alias("layer"),
    )


def content_address(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text_functions.short_digest(F.col("text")).alias("address"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (token_synonyms, idf_table, tfidf_top_k, tfidf_similar, tfidf_unmatched, search_filtered, index_search, index_vocabulary, index_similar, search_router, schema_violations, schema_bootstrap, url_parts, content_address)
} | {name: _compiled(sentence) for name, (sentence, _) in SENTENCES.items()}

_STOPS = ", ".join(f"'{w}'" for w in text_functions.STOP_WORDS)
_SYNONYMS = ", ".join(f"('{a}', '{b}')" for a, b in text_functions.SYNONYMS.items())


def _terms(source: str) -> str:
    return f"""
synonyms(word, name) AS (VALUES {_SYNONYMS}),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM {source}),
terms AS (SELECT doc_id, coalesce(name, w.word) AS term FROM words w LEFT JOIN synonyms s ON s.word = w.word WHERE length(w.word) >= 2 AND w.word NOT IN ({_STOPS}))"""


def _index(source: str) -> str:
    return f"""{_terms(source)},
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1e0 + (SELECT count(*) FROM {source})) / (1e0 + count(*))) + 1e0 AS idf FROM counts GROUP BY 1),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS r FROM counts JOIN idf USING (term)),
vec AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


_INDEX = _index("documents")
_LEFT = f"""left_over AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN concat_ws(' ', text, 'Forest clown by the river') ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src3'
), {_index("left_over")}"""
_QUERY = f"""asked AS (SELECT 0 AS doc_id, '{_ASKED}' AS text),
qwords AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM asked),
qterms AS (SELECT coalesce(name, q.word) AS term, count(*) AS tf FROM qwords q LEFT JOIN synonyms s ON s.word = q.word WHERE length(q.word) >= 2 AND q.word NOT IN ({_STOPS}) GROUP BY 1),
qraw AS (SELECT q.term, (1 + ln(tf)) * coalesce(idf, 1e0) AS r FROM qterms q LEFT JOIN idf USING (term)),
qvec AS (SELECT term, r / sqrt(sum(r * r) OVER ()) AS qw FROM qraw),
hits AS (SELECT doc_id, sum(w * qw) AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM vec JOIN qvec USING (term) GROUP BY 1)"""

ORACLE_SQL: dict[str, str] = {
    "token_synonyms": f"WITH extended AS (SELECT doc_id, text || ' Forest river photo the drone' AS text FROM documents), {_terms('extended')} SELECT term, count(*) AS n FROM terms GROUP BY 1",
    "idf_table": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_top_k": f"WITH {_INDEX}, {_QUERY} SELECT doc_id, round(score, 6) AS score, matched FROM hits ORDER BY round(score, 8) DESC, doc_id LIMIT 10",
    "tfidf_similar": f"WITH {_INDEX} SELECT b.doc_id, round(sum(a.w * b.w), 6) AS score FROM vec a JOIN vec b ON a.term = b.term AND a.doc_id = {_ANCHOR} AND b.doc_id <> {_ANCHOR} GROUP BY 1 ORDER BY round(sum(a.w * b.w), 8) DESC, 1 LIMIT 10",
    "tfidf_unmatched": f"WITH {_INDEX}, {_QUERY} SELECT term FROM qterms WHERE term NOT IN (SELECT term FROM idf)",
    "index_search": f"WITH {_LEFT}, {_QUERY} SELECT doc_id, round(score, 6) AS score, matched FROM hits ORDER BY round(score, 8) DESC, doc_id LIMIT 10",
    "index_vocabulary": f"WITH {_LEFT} SELECT term, df FROM idf",
    "index_similar": f"WITH {_LEFT} SELECT b.doc_id, round(sum(a.w * b.w), 6) AS score FROM vec a JOIN vec b ON a.term = b.term AND a.doc_id = {_ANCHOR} AND b.doc_id <> {_ANCHOR} GROUP BY 1 ORDER BY round(sum(a.w * b.w), 8) DESC, 1 LIMIT 10",
    "search_filtered": f"WITH {_INDEX}, {_QUERY} SELECT doc_id, round(score, 6) AS score FROM hits JOIN documents USING (doc_id) WHERE coalesce(source, '') IN ('', 'src3') AND lower(lang) = 'en' ORDER BY round(score, 8) DESC, doc_id LIMIT 10",
    "search_router": "SELECT o_orderkey AS asset_id, 'structured' AS way FROM orders WHERE o_orderstatus = 'F' AND o_totalprice / 1000 >= 450",
    "schema_violations": """
WITH p AS (
  SELECT list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus:not_allowed' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-[A-Z ]+$') THEN 'o_orderpriority:pattern' END,
    CASE WHEN o_totalprice < 2000 THEN 'o_totalprice:too_low' WHEN o_totalprice > 450000 THEN 'o_totalprice:too_high' END], lambda x: x IS NOT NULL) AS problems FROM orders
) SELECT problems[1] AS first_problem, count(*) AS n, sum(len(problems))::BIGINT AS problems FROM p WHERE len(problems) > 0 GROUP BY 1""",
    "schema_bootstrap": """
SELECT coalesce(w.n_name, e.n_name) AS name, CASE WHEN e.n_name IS NULL THEN 'created' WHEN w.n_name IS NULL THEN 'extra' WHEN w.n_regionkey = e.n_nationkey % 5 THEN 'unchanged' ELSE 'updated' END AS action
FROM (SELECT * FROM nation WHERE n_nationkey < 20) w FULL JOIN (SELECT * FROM nation WHERE n_nationkey >= 5) e ON w.n_name = e.n_name""",
    "url_parts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/', ':') AS layer FROM pages",
    "content_address": "SELECT doc_id, substr(sha256(text), 1, 16) AS address FROM documents",
} | {name: _ASSETS + where for name, (_, where) in SENTENCES.items()}
