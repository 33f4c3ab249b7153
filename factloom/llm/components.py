"""Connected components of a table of links by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import drop_settled, settle


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each node's least neighbour. The double complement hides that the rows lie by node already, so that Spark deals both sides of the join anew and can split a node with very many links."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    return least.select(F.bitwise_not(F.bitwise_not("node")).alias("node"), "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
    least = _smallest(both).select("node", F.least("node", "least").alias("least"))
    joined = both.where("other > node").join(least.hint("merge"), "node")
    return joined.where("other > least").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    pairs = links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    joined = pairs.join(_smallest(pairs).hint("merge"), "node")
    to_least = joined.where("other > least").select(F.col("other").alias("high"), F.col("least").alias("low"))
    return to_least.unionByName(joined.select(F.col("node").alias("high"), F.col("least").alias("low"))).distinct()


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("x")).first()
    return row.n, row.x


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """links: a, b (long). Each node of any link with the smallest node that it can reach: node, root (settled).

    Links of a node with itself count for nothing. A node with very many links is only a skewed join key, whose
    partitions Spark splits; its smallest neighbour is found by partial aggregation.
    """
    current = settle(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    before = _signature(current)
    for _ in range(rounds):
        following = settle(_small_star(_large_star(current)))
        drop_settled(current)
        current, after = following, _signature(following)
        if after == before:
            return current.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = after
    raise RuntimeError(f"links did not come to rest in {rounds} rounds")
