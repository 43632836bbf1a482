"""Splits that don't leak: spatial clusters, folds, grouped hold-outs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from standmap.operators.select import seeded
from standmap.sources.store import row_numbers


def spatial_clusters(feat: DataFrame, k: int = 10, seeds: Sequence[int] = (1, 2, 3), columns: tuple[str, str] = ("cx", "cy"), into: str = "area_cluster") -> DataFrame:
    """``feat`` with the cluster of each centroid: k-means, the best of several seeds by training cost."""
    x = VectorAssembler(inputCols=list(columns), outputCol="__v", handleInvalid="skip").transform(feat)
    models = [KMeans(k=k, seed=s, featuresCol="__v", predictionCol=into).fit(x) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost).transform(x).drop("__v")


def spatial_folds(tiles: DataFrame, source: str, k: int = 5, seed: int = 42, columns: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """``tiles`` with ``fold`` 0 to k - 1 and ``spatial``: sources are clustered and their members inherit it; sources without place go round-robin.

    Where fewer than ``k`` sources have a place, all go by seeded order instead, and ``spatial`` is false: scores of such
    folds are optimistic. Rows without a source have no fold.
    """
    a, b = columns
    s = tiles.where(F.col(source).isNotNull()).groupBy(source).agg(F.avg(a).alias("__a"), F.avg(b).alias("__b"))
    located = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    if s.where(located).limit(k).count() < k:
        n = row_numbers(s.select(source), [seeded(source, seed), F.col(source)])
        return tiles.join(n.select(source, ((F.col("rn") - 1) % k).cast("int").alias("fold"), F.lit(False).alias("spatial")), source, "left")
    near = spatial_clusters(s.where(located), k, (seed, seed + 1, seed + 2), ("__a", "__b"), "fold").select(source, "fold")
    rest = row_numbers(s.where(~located).select(source), [source]).select(source, ((F.col("rn") - 1) % k).cast("int").alias("fold"))
    return tiles.join(near.unionByName(rest).withColumn("spatial", F.lit(True)), source, "left")


def fold_sizes(folds: DataFrame) -> DataFrame:
    """(fold, tiles, spatial, uneven): rows of each fold; ``uneven`` on all of them if the largest has over three times the smallest, so that per-fold numbers are noisy."""
    n = folds.where("fold is not null").groupBy("fold").agg(F.count(F.lit(1)).alias("tiles"), F.bool_and("spatial").alias("spatial"))
    most = n.agg((F.max("tiles") > 3 * F.min("tiles")).alias("uneven"))
    return n.crossJoin(F.broadcast(most))  # one row


def random_folds(df: DataFrame, k: int, seed: int, id_: str = "tile_id") -> DataFrame:
    """``df`` with ``fold`` 1 to k, sizes one apart at most, by seeded order."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    out = row_numbers(df, [seeded(id_, seed), F.col(id_)]).crossJoin(F.broadcast(n))  # one row
    size, more = F.floor(F.col("__n") / k), F.col("__n") % k
    i = F.col("rn") - 1
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return out.withColumn("fold", (fold + 1).cast("int")).drop("rn", "__n")


def group_holdout(df: DataFrame, group: str, frac: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: a share of groups (one at least), by seeded order, is ``val``; no group is on both sides."""
    g = df.select(group).distinct()
    n = max(1, round(frac * g.count()))
    val = row_numbers(g, [seeded(group, seed), F.col(group)], "__n").where(F.col("__n") <= n).select(group, F.lit(True).alias("__v"))
    return df.join(val, group, "left").withColumn("part", F.when(F.col("__v"), "val").otherwise("train")).drop("__v")


def nested_inner_split(folds: DataFrame, frac: float = 0.15, min_n: int = 4, seed: int = 42, id_: str = "tile_id", fold: str = "fold") -> DataFrame:
    """(outer_fold, id, inner): per held-out fold, which training rows choose its settings: a share, ``min_n`` at least."""
    f = folds.select(F.col(fold).alias("outer_fold")).distinct()
    train = folds.select(id_, F.col(fold).alias("__f")).crossJoin(F.broadcast(f)).where("__f <> outer_fold")  # a row per fold
    n = train.groupBy("outer_fold").agg(F.greatest(F.lit(min_n), F.bround(F.count(F.lit(1)) * frac)).cast("long").alias("__n"))
    out = row_numbers(train, ["outer_fold", seeded(id_, seed), F.col(id_)])
    low = out.groupBy("outer_fold").agg(F.min("rn").alias("__lo"))
    out = out.join(F.broadcast(n), "outer_fold").join(F.broadcast(low), "outer_fold")
    return out.select("outer_fold", id_, (F.col("rn") - F.col("__lo") < F.col("__n")).alias("inner"))


def leakage_check(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """(group, folds): groups on both sides of some split."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")
