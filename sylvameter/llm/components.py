"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import own_exchange
from sylvameter.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(own_exchange(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(own_exchange(least, "a"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs), where root is the least node it can reach.

    Self-links and repeated links do no harm and a link with a null end is none; no edges give no rows. All state
    stays in executors and in the checkpoint folder; the driver sees one count and one checksum a round.
    """
    links = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(most_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1_000_000_007))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        links = materialise(_small_star(_large_star(links).distinct()).distinct())
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
