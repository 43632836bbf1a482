"""Reports over runs and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmap.sources.store import materialize, quantiles


def slice_report(scores: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """(by, n, mean of each metric) with overall rows' mean and median beside; worst first by the first metric."""
    scores = materialize(scores.select(by, *metrics))  # read for the groups, the means and each median
    over = scores.agg(*(F.avg(m).alias(f"{m}_overall") for m in metrics))
    for m in metrics:
        over = over.crossJoin(quantiles(scores, m, [0.5]).select(F.get("q", F.lit(0)).alias(f"{m}_median")))  # one row
    out = scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics))
    return out.crossJoin(F.broadcast(over)).orderBy(metrics[0], by)  # one row


def run_stability(runs: DataFrame, config: Sequence[str], score: str = "iou") -> DataFrame:
    """(config, n, mean, sd, low, high, believable): runs of one configuration; differences below 2 sd are noise."""
    s = runs.where(F.col(score).isNotNull()).groupBy(*config).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.min(score).alias("low"), F.max(score).alias("high"))
    return s.withColumn("believable", 2 * F.col("sd"))


def version_comparison(runs: DataFrame, current: str, version: str = "train_ver", score: str = "iou") -> DataFrame:
    """(version, n, mean, diff, beyond): ``current`` against each other version of two runs or more: is it outside that one's 2 sd?"""
    g = runs.where(F.col(score).isNotNull()).groupBy(version).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"))
    now = g.where(F.col(version) == current).select(F.col("mean").alias("m"))
    out = g.where((F.col(version) != current) & (F.col("n") >= 2)).crossJoin(F.broadcast(now))  # one row
    return out.select(version, "n", "mean", (F.col("m") - F.col("mean")).alias("diff"), (F.abs(F.col("m") - F.col("mean")) > 2 * F.col("sd")).alias("beyond"))


def learning_curve(runs: DataFrame, size: str = "n_damage", score: str = "iou") -> DataFrame:
    return runs.groupBy(size).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))


def headline_report(scores: DataFrame) -> DataFrame:
    """One row that sums up a run, from (tile_id, fold, iou, prior_iou, zero_iou, fixed_iou, recall, silent, painted) of its tiles.

    Means are over tiles whose value is known. ``gain`` is over copying the prior, and beyond 0.03 the model reads damage
    from the imagery; ``zero_gain`` is over the model as it came. ``painted`` is the painted share of damage-free tiles
    (null on others): a commission below 5% is quiet. ``ab_delta``: the same predictions under the fixed threshold less
    under the tuned one, over tiles that have both. ``folds`` are the folds' means of iou, by fold, with their range.
    """
    s = scores.agg(
        F.count(F.lit(1)).alias("tiles"), *(F.avg(c).alias(c) for c in ("iou", "prior_iou", "zero_iou", "recall")), F.count_if("silent").alias("silent"), F.stddev_samp("iou").alias("sd"),
        F.avg("painted").alias("commission"), F.count("painted").alias("healthy"), F.avg(F.col("fixed_iou") - F.col("iou")).alias("ab_delta"),
    )
    f = scores.groupBy("fold").agg(F.avg("iou").alias("m")).where("m is not null")
    f = f.agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "m"))), lambda r: F.round(r["m"], 3)).alias("folds"), (F.max("m") - F.min("m")).alias("fold_range"))  # a value per fold
    gain = F.col("iou") - F.col("prior_iou")
    verdicts = {
        "verdict": F.when(gain > 0.03, "reads damage from the imagery").otherwise("mostly echoes the prior"),
        "commission_verdict": F.when(F.col("commission") < 0.05, "quiet on healthy forest").when(F.col("commission").isNotNull(), "paints healthy forest"),
        "recall_ok": F.col("recall") > 0.5,
    }
    return s.withColumns({"gain": gain, "zero_gain": F.col("iou") - F.col("zero_iou")}).withColumns(verdicts).crossJoin(f)  # one row each
