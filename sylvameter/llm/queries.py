"""The queries of the text preparation operators, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvameter.llm import (
    alignment,
    contamination,
    extraction,
    interactions,
    langid,
    linededup,
    packing,
    quality,
    secrets,
    simhash,
    tokencount,
    tokens,
    topk,
    toxicity,
)
from sylvameter.llm.common import held_out
from sylvameter.session import spread
from sylvameter.sources.tables import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in the sequences of 2048 ids."""
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), tokens.byte_bpe_path())


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(spread(table(spark, sf_dir, "pages")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites share."""
    cleaned = linededup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four fifths of them."""
    docs = spread(table(spark, sf_dir, "documents"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score_toxicity(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the text and language of four fifths of them."""
    docs = spread(table(spark, sf_dir, "documents"))
    model = langid.train(docs, ~held_out())
    return langid.identify(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return tokencount.count_tokens(spread(table(spark, sf_dir, "documents")), tokencount.piece_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return contamination.find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id that links of three bits or fewer reach."""
    groups = simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every document; columns as the contract of the query names them."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("findings")).alias("spans"),
        F.size(F.filter("findings", lambda f: f["live"])).cast("long").alias("n_live"),
        F.size(F.filter("findings", lambda f: ~f["live"])).cast("long").alias("n_example"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of the byte-level and of the piece vocabulary meet in every document, and how usual their links are."""
    return alignment.align_corpus(spread(table(spark, sf_dir, "documents")), tokens.byte_bpe_path(), tokencount.piece_path())


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and verdict of every document, read off the ledger under the fullest policy."""
    found = quality.judge(quality.ledger(spread(table(spark, sf_dir, "documents"))))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *base, "base_failed", "kept", "failed", "policy")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the quality policy loses by each of its rules, by language."""
    found = quality.ledger(spread(table(spark, sf_dir, "documents")), quality.RULES, "lang")
    return quality.ablations(found, part="lang")


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each of their orders, by language."""
    return interactions.audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_html_extraction": op3_html_extraction,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_secret_ownership": op10_secret_ownership,
    "op11_token_alignment": op11_token_alignment,
    "op12_quality_rules": op12_quality_rules,
    "op13_filter_interactions": op13_filter_interactions,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": topk.oracle_sql(),
    "op4_line_dedup": linededup.oracle_sql(),
    "op8_decontamination": contamination.oracle_sql(),
    "op10_secret_ownership": secrets.oracle_sql(),
    "op12_quality_rules": quality.oracle_sql(),
    "op13_filter_interactions": interactions.oracle_sql(),
    "quality_ablations": quality.ablations_sql(),
}
