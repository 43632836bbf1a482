"""Connected components of an edge table within keys, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmap.sources.store import materialize


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every larger neighbour of a node, linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(*keys, "a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every smaller neighbour of a node, and the node, linked to the least of them."""
    down = edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    linked = down.join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select(*keys, "a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, keys: Sequence[str] = (), limit: int = 60) -> DataFrame:
    """(keys, node, component) of the nodes of ``edges`` (keys, a, b): the least node within reach, for those that aren't it themselves.

    Each round writes its edges, of which there are fewer and fewer, and stops when they link every node to its least.
    """
    keys = list(keys)
    now = materialize(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(limit):
        # settled: no node has two targets, and no target has one
        twice = now.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
        chained = now.select(*keys, F.col("b").alias("a")).join(now.select(*keys, "a"), [*keys, "a"], "left_semi").select(*keys)
        if twice.unionByName(chained).isEmpty():
            return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
        now = materialize(_small_star(_large_star(now, keys), keys), "edges")
    raise RuntimeError("components did not converge")
