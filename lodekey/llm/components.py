"""Connected components by alternating large and small stars.

Each round moves links towards the smallest node of their neighbourhood; the
number of rounds grows with the logarithm of a component's size.  Links are
tables throughout: each round is aggregations and joins on a node, and ends
with a written table.  Joins have a hash of the node as a second key, so that
their sides are dealt anew, not by the aggregation before; only then can Spark
split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.llm import staging


def _met(rows: DataFrame, least: DataFrame) -> DataFrame:
    key = F.hash("u").alias("h")
    return rows.select("u", "v", key).join(least.select("u", "m", key), ["u", "h"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _met(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(down, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (its component's smallest node) of all linked nodes.

    ``links`` has columns ``u`` and ``v`` of one ordered type, without nulls.
    """
    edges = staging.stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
        edges = staging.stage(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
