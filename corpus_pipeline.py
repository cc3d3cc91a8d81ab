"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
result of a stage is written as Parquet in the shared folder and read again by the next, which cuts the lineage there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvameter.llm import contamination, langid, linededup, neardup, packing, tokens
from sylvameter.llm.common import held_out
from sylvameter.session import remove, scratch, shared_folder, ship
from sylvameter.sources.tables import table

#: Least posterior of the predicted language for a document to stay, and least fit to that language: the mean log
#: probability of its n-grams, less the language's usual one. Of 10,000 documents the lowest had -2.6; texts in other
#: languages and scripts, hexadecimal and base64 data had -3.2 to -8.5.
LEAST_POSTERIOR, LEAST_FIT = 0.5, -3.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells.

    Those without a letter go, and those in doubt between languages or far from all that the model knows. If no row
    says what languages there are, every text with a letter stays.
    """
    ship(spark)
    return langid.in_a_language(docs, langid.train(docs, ~held_out()), LEAST_POSTERIOR, LEAST_FIT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; those that consist of nothing else go."""
    cleaned = linededup.remove_boilerplate(docs)
    n_removed = F.col(cleaned.columns[-1])  # the last of its columns, whatever name was free
    left = cleaned.where((n_removed == 0) | F.col("text").rlike(r"\S"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "n_chars"]
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*columns, n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of a Jaccard similarity of 0.8 or more."""
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack_documents(docs, tokens.byte_bpe_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the model, fingerprint and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote goes once the next one has read it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}.parquet"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
