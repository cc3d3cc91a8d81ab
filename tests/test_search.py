import pytest
from pyspark.sql import functions as F

from sylvameter.functions import text
from sylvameter.operators import grounding, nlquery, search, validation
from sylvameter.operators.nlquery import CompilationError, Constraint
from sylvameter.sources import corpus

CASES = [
    ("canopy growth between 20 and 40 percent", {Constraint("canopy_delta_pct", "between", 20, 40)}),
    ("confidence between 50 and 70 percent", {Constraint("jev_confidence_score", "between", 50, 70)}),
    ("quarantined photos with confidence under 60 percent", {Constraint("jev_triage_decision", "eq", "QUARANTINE_FRAUD"), Constraint("jev_confidence_score", "le", 60)}),
    ("assets with canopy growth less than -10 percent", {Constraint("canopy_delta_pct", "le", -10)}),
    ("month 18 progress assets", {Constraint("milestone_phase", "eq", "progress_month_18")}),
    (
        "verified mangrove assets for KEN-042 with canopy over 30 percent",
        {Constraint("jev_triage_decision", "eq", "VERIFIED_PASS"), Constraint("sustainability_domain", "eq", "mangrove_restoration"), Constraint("esg_project_id", "eq", "KEN-042"), Constraint("canopy_delta_pct", "ge", 30)},
    ),
    ("assets after 2025", {Constraint("capture_timestamp", "ge", "2025-01-01")}),
    ("assets before 2025", {Constraint("capture_timestamp", "lt", "2025-01-01")}),
]


@pytest.mark.parametrize("sentence, wanted", CASES)
def test_sentences(sentence, wanted):
    assert set(nlquery.compile_query(sentence).constraints) == wanted


@pytest.mark.parametrize("sentence", ["canopy between 40 and 20 percent", "confidence between 50 and 900 percent", "show me the pretty pictures of trees", "assets from 1200"])
def test_sentences_that_do_not_compile(sentence):
    with pytest.raises(CompilationError):
        nlquery.compile_query(sentence)


def test_a_sentence_cannot_smuggle_sql(spark):
    rows = nlquery.run_query(corpus.assets(spark), "verified assets ' OR 1=1 --")
    assert rows.count() == sum(r["jev_triage_decision"] == "VERIFIED_PASS" for r in corpus.generate())


def test_router(spark):
    df = corpus.assets(spark)
    assert nlquery.route(df, "verified assets", lambda s: df)[0] == "structured"
    assert nlquery.route(df, "mangrove water", lambda s: df)[0] == "lexical"
    assert nlquery.compile_query("verified qwerty assets").unparsed == ("qwerty",)


def _index(spark):
    rows = [
        (1, "mangrove water canopy tidal creek", ["mangrove"], "A"), (2, "rhizophora seedlings in tidal water canopy", ["mangrove"], "A"), (3, "mangrove estuary canopy", ["mangrove"], None),
        (4, "pine forest on dry soil", ["forest"], "B"), (5, "pine saplings", ["forest"], "B"), (6, "solar panel array", ["infra"], "C"), (7, "substation grid", ["infra"], "C"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, tags array<string>, project_id string")


def test_search_ranks_groups(spark):
    docs = _index(spark)
    hits = search.search(docs, "mangrove water canopy", 10).orderBy(F.desc("score")).collect()
    assert {h.doc_id for h in hits[:3]} == {1, 2, 3} and all(0 < h.score <= 1 + 1e-9 for h in hits)
    assert {h.doc_id for h in search.search(docs, "canopy pine", 10, project="B").collect()} == {3, 4, 5}
    assert {h.doc_id for h in search.search(docs, "canopy pine", 10, tags=["FOREST"]).collect()} == {4, 5}
    assert [r.doc_id for r in search.similar_to(docs, 4, 1).collect()] == [5]
    assert {r.term for r in search.unmatched(spark, "mangrove zebra", search.term_counts(docs)).collect()} == {"zebra"}
    assert search.search(docs.limit(0), "mangrove", 5).count() == 0


def test_validation(spark):
    df = corpus.assets(spark)
    assert validation.validate(df).where("first_problem is not null").count() == 0
    bad = df.limit(1).withColumn("esg_project_id", F.lit("nope")).withColumn("canopy_delta_pct", F.lit(900.0)).withColumn("capture_timestamp", F.lit("yesterday"))
    row = validation.validate(bad).first()
    assert row.first_problem == "esg_project_id:pattern" and row.problems == ["esg_project_id:pattern", "capture_timestamp:date", "canopy_delta_pct:too_high"]
    one = spark.range(1).select(*[validation.safe_public_id(F.lit(x)).alias(str(i)) for i, x in enumerate(("a/b-c_d", "a.b", "/a", "a/../b", "a b", "a\n", "", "x" * 255, "x" * 256))]).first()
    assert list(one) == [True, False, False, False, False, False, False, True, False]
    parts = ("north_east", "Arial:bold", "co_rgb.1,x-2", "a/b", "a b", "")
    assert [r for r in spark.range(1).select(*[validation.safe_component(F.lit(x)).alias(str(i)) for i, x in enumerate(parts)]).first()] == [True, True, True, False, False, False]
    keys = spark.range(1).select(validation.unknown_fields(F.create_map(F.lit("x"), F.lit(1), F.lit("milestone_phase"), F.lit(2)))).first()[0]
    assert keys == ["x"] and len(validation.schema_digest()) == 16


def test_grounding(spark):
    df = spark.createDataFrame([("Verra VM0047 under ESRS E4: 9.3 tCO2e, +12.5% on 1,100 stems, Article 9.", 9.314, 12.5, 1100.0), ("It is 7 or 8.", 7.0, None, None)], "t string, a double, b double, c double")
    rows = grounding.check(df, "t", ["a", "b", "c"]).collect()
    assert rows[0].grounded and rows[0].n_figures == 3
    assert rows[1].ungrounded == ["8"]


def test_rewritten_summaries_must_be_grounded(spark):
    df = spark.createDataFrame([(5.0, "There are 5.", "It is 5."), (5.0, "There are 6.", "It is 5."), (5.0, None, "It is 5.")], "n double, new string, summary string")
    assert [(r.text, r.text_source) for r in grounding.enhanced(df, "new", ["n"]).collect()] == [("There are 5.", "REWRITTEN"), ("It is 5.", "TEMPLATE"), ("It is 5.", "TEMPLATE")]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.slug(F.lit("Bare Soil_2!")).alias("slug"), text.title(F.lit("bare_soil")).alias("title"), text.percent_encode(F.lit("a b/c*~")).alias("url"), text.layer_reference(F.lit("a/b")).alias("layer"),
        text.caption_time(F.lit(3599.9996)).alias("t"), text.caption_time(F.lit(float("nan"))).alias("nan"), text.parse_caption_time(F.lit("01:00:00.500")).alias("p"), text.cue_text(F.lit("a --> b")).alias("cue"),
        text.cue_text(F.lit("a\n b")).alias("line"), text.signed_percent(F.lit(3.25)).alias("pct"), text.parent_folder(F.lit("a/b/c")).alias("dir"), text.terms(F.lit("The Trees of x 42")).alias("terms"),
    ).first()
    assert (row.slug, row.title, row.url, row.layer) == ("bare-soil-2", "Bare Soil", "a%20b%2Fc%2A~", "a:b")
    assert (row.t, row.nan, row.p, row.cue, row.line) == ("01:00:00.000", "00:00:00.000", 3600.5, None, "a b")
    assert (row.pct, row.dir, row.terms) in (("+3.3%", "a/b", ["tree", "42"]), ("+3.2%", "a/b", ["tree", "42"]))
