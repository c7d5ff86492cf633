"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _join(edges: DataFrame, least: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with what is told of their node; where there are many, the rows of hubs stay where they are."""
    if n <= common.BROADCAST_KEYS:
        return edges.join(least, key)
    return common.join_by_count(edges, common.materialize(least, "least"), key, "c", n)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour; ``n`` is the number of edges."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    return _join(both, least, "u", 2 * n).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them; ``n`` is the number of edges at most."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
    moved = _join(edges, least, "a", n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node.

    Each round is written to the shared folder. A node's neighbours are only ever
    reduced to a minimum and joined back, never gathered, and the rows of a hub stay where they are.
    Self loops are ignored and an edge may be given several times or both ways round.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.materialize(now, "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
        now = common.materialize(_small_star(_large_star(now, state[0]), 2 * state[0]), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
