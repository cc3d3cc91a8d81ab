"""Reading the analytic tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvameter.session import ship

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; any file system Spark can read."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
