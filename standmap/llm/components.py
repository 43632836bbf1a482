"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmap.llm.common import discard, materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or those not above it and itself) linked to its least neighbour."""
    if larger:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of ``edges`` (a, b).

    Nodes are of any ordered type; nulls and loops are passed over. Each round writes its edges to the shared folder,
    and a count of changed edges is all that the driver sees. An empty table gives an empty result.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(limit):
        if now.isEmpty():
            break
        stars = materialize(_star(_star(now, True), False), "edges")
        changed = not stars.exceptAll(now).isEmpty() or stars.count() != now.count()
        discard(now.sparkSession, now)
        now = stars
        if not changed:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
