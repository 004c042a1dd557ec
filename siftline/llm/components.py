"""Connected components of an undirected graph, by alternating large and small stars.

Every round is a minimum by node (combined before the shuffle) and a join with one row a node on
the other side, so that a hub's many links are never gathered in one place.  Rounds are cut by
reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v): a row (u, v) for each node u but the least of its component, v being that least node."""
    edges = checkpointed(edges.select("u", "v").where("u != v").distinct())
    stamp = None
    while stamp != (now := _stamp(edges)):
        stamp = now
        if now[0]:
            edges = checkpointed(_small_star(_large_star(edges)))
    return edges
