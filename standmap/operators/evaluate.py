"""Scores of predictions against labels. Undefined metrics are null, never NaN; ``pred`` and ``valid`` are boolean columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from standmap.functions.spectral import excess_green, ngrdi
from standmap.functions.tails import normal_two_sided, student_two_sided
from standmap.operators.raster import KEY, connected_components, morphologies
from standmap.sources.store import materialize, quantiles, row_numbers, running_sums

#: Damage beats ignore: a pixel counts unless it is ignored and not damage.
VALID = "gt or not ign"


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def _counts(px: DataFrame, pred: Column | str, gt: Column | str, valid: Column | str, by: Sequence[str]) -> DataFrame:
    p, g, v = (F.expr(c) if isinstance(c, str) else c for c in (pred, gt, valid))
    n = lambda c: F.count_if(c & v)
    return px.groupBy(*by).agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"), F.count_if(v).alias("n"))


def _iou(empty: str = "null") -> Column:
    """Null on an empty label (the headline rule), or 0 or 1 where label and prediction are both empty."""
    union = F.col("tp") + F.col("fp") + F.col("fn")
    if empty == "null":
        return F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / union)
    return F.when(union > 0, F.col("tp") / F.nullif(union, F.lit(0))).otherwise({"zero": 0.0, "one": 1.0}[empty])


def _dice(empty: str = "null") -> Column:
    both = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    if empty == "null":
        return F.when(F.col("tp") + F.col("fn") > 0, 2 * F.col("tp") / both)
    return F.when(both > 0, 2 * F.col("tp") / F.nullif(both, F.lit(0))).otherwise({"zero": 0.0, "one": 1.0}[empty])


def iou_dice(px: DataFrame, pred: Column | str, gt: Column | str = "gt", valid: Column | str = VALID, empty: str = "null") -> DataFrame:
    c = _counts(px, pred, gt, valid, ["tile_id"])
    return c.select("tile_id", _iou(empty).alias("iou"), _dice(empty).alias("dice"))


def tile_scores(px: DataFrame, pred: Column | str, gt: Column | str = "gt", valid: Column | str = VALID) -> DataFrame:
    """(tile_id, iou, recall, silent) in one pass; iou and recall are null on tiles without label."""
    c = _counts(px, pred, gt, valid, ["tile_id"])
    return c.select("tile_id", _iou().alias("iou"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), (F.col("tp") + F.col("fp") == 0).alias("silent"))


def region_iou(px: DataFrame, pred: Column | str, gt: str = "gt", valid: str = VALID, k: int = 4) -> DataFrame:
    """IoU after the prediction is dilated and closed with a k x k square; 0 where both are empty."""
    p = px.withColumn("__p", F.expr(pred) if isinstance(pred, str) else pred)
    p = morphologies(p, "__p", [("dilate", "square", 1), ("close", "square", 1)], k)
    return iou_dice(p, F.col("__p"), gt, valid, "zero").select("tile_id", "iou")


def confusion_micro(px: DataFrame, pred: Column | str, gt: Column | str = "gt", valid: Column | str = VALID) -> DataFrame:
    c = _counts(px, pred, gt, valid, [])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", _ratio(tp, tp + fp + fn).alias("iou"), _ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"))


def macro_scores(px: DataFrame, pred: Column | str, gt: Column | str = "gt", valid: Column | str = VALID) -> DataFrame:
    """Mean Dice and recall over tiles with label, and the painted share of all pixels of tiles without."""
    c = _counts(px, pred, gt, valid, ["tile_id"])
    has = F.col("tp") + F.col("fn") > 0
    return c.agg(
        F.count_if(has).alias("n_damage"), F.avg(F.when(has, _dice())).alias("dice"), F.avg(F.when(has, F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))).alias("recall"),
        _ratio(F.sum(F.when(~has, F.col("fp"))), F.sum(F.when(~has, F.col("n")))).alias("false_positive_rate"),
    )


def object_recall(px: DataFrame, pred: Column | str, gt: str = "gt", connectivity: int = 4) -> DataFrame:
    """(blobs, touched, recall): labelled blobs that any predicted pixel touches."""
    blobs = connected_components(px, gt, connectivity)
    p = px.select(*KEY, (F.expr(pred) if isinstance(pred, str) else pred).alias("__p"))
    t = blobs.join(p, KEY).groupBy("tile_id", "blob").agg(F.bool_or("__p").alias("hit"))
    return t.agg(F.count(F.lit(1)).alias("blobs"), F.count_if("hit").alias("touched")).withColumn("recall", _ratio(F.col("touched"), F.col("blobs")))


def recall_precision(px: DataFrame, pred: Column | str, gt: Column | str = "gt", valid: Column | str = VALID) -> DataFrame:
    """Per damage tile: recall, precision (null if silent), painted / labelled area, silent and paint-everything flags.

    A tile paints everything if its recall is above 0.95 while its precision is below 0.1.
    """
    c = _counts(px, pred, gt, valid, ["tile_id"]).where("tp + fn > 0")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    recall, precision = tp / (tp + fn), _ratio(tp, tp + fp)
    paints = F.coalesce((recall > 0.95) & (precision < 0.10), F.lit(False))
    return c.select("tile_id", recall.alias("recall"), precision.alias("precision"), ((tp + fp) / (tp + fn)).alias("area_ratio"), (tp + fp == 0).alias("silent"), paints.alias("paints_all"))


def recall_precision_summary(per_tile: DataFrame) -> DataFrame:
    """Means over tiles: ``precision`` leaves silent tiles out, ``precision_like`` counts them as 0, ``recall_clean`` leaves out
    tiles that paint everything; with the medians of recall and area ratio."""
    per_tile = materialize(per_tile)  # read once for the means and once for each median
    s = per_tile.agg(
        F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision_like"),
        F.avg(F.when(~F.col("paints_all"), F.col("recall"))).alias("recall_clean"), F.count_if("silent").alias("silent"), F.count_if("paints_all").alias("paints_all"),
    )
    for c in ("recall", "area_ratio"):
        s = s.crossJoin(quantiles(per_tile, c, [0.5]).select(F.get("q", F.lit(0)).alias(f"{c}_median")))  # one row
    return s


def baselines(px: DataFrame, model: str, prior: str, zero_shot: str, gt: str = "gt", valid: str = VALID) -> DataFrame:
    """(model, prior_echo, zero_shot, gain_prior, gain_zero): mean IoU of each on damage tiles, and the model's gains, in one pass."""
    names = {"model": model, "prior_echo": prior, "zero_shot": zero_shot}
    n = lambda c: F.count_if(F.expr(f"({valid}) and ({c})"))
    t = px.groupBy("tile_id").agg(n(gt).alias("g"), *(n(f"({p}) and {gt}").alias(f"i_{k}") for k, p in names.items()), *(n(f"({p}) or {gt}").alias(f"u_{k}") for k, p in names.items())).where("g > 0")
    m = t.agg(*(F.avg(F.col(f"i_{k}") / F.col(f"u_{k}")).alias(k) for k in names))
    return m.withColumns({"gain_prior": F.col("model") - F.col("prior_echo"), "gain_zero": F.col("model") - F.col("zero_shot")})


def commission(px: DataFrame, pred: Column | str, prior: Column | str, gt: Column | str = "gt", valid: Column | str = VALID) -> DataFrame:
    """Painted share of damage-free tiles by the model and by the prior, and the worst tile."""
    p, q, g, v = (F.expr(c) if isinstance(c, str) else c for c in (pred, prior, gt, valid))
    t = px.groupBy("tile_id").agg(F.count_if(g & v).alias("g"), F.count_if(p & v).alias("p"), F.count_if(q & v).alias("q"), F.count_if(v).alias("n")).where("g = 0 and n > 0")
    return t.agg(F.count(F.lit(1)).alias("tiles"), F.avg(F.col("p") / F.col("n")).alias("painted"), F.avg(F.col("q") / F.col("n")).alias("prior_painted"), F.max(F.col("p") / F.col("n")).alias("worst"))


def per_source_mean(scores: DataFrame, source: str, metric: str = "iou") -> DataFrame:
    """(sources, crops, mean_of_means, mean_crops): every source weighs the same."""
    s = scores.where(F.col(metric).isNotNull()).groupBy(source).agg(F.avg(metric).alias("m"), F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").cast("long").alias("crops"), F.avg("m").alias("mean_of_means"), F.avg("n").alias("mean_crops"))


def threshold_sweep(px: DataFrame, prob: str, thresholds: Sequence[float], gt: str = "gt", valid: str = VALID) -> DataFrame:
    """(thr, tp, fp, fn, precision, recall, dice, iou) pooled over pixels, in one pass."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))
    # pixels of one probability first, so that thresholds multiply far fewer rows
    c = px.where(valid).groupBy(prob).agg(F.count_if(gt).alias("g"), F.count(F.lit(1)).alias("n")).withColumn("thr", t)
    on = F.col(prob) > F.col("thr")
    s = c.groupBy("thr").agg(F.sum(F.when(on, F.col("g")).otherwise(0)).cast("long").alias("tp"), F.sum(F.when(on, F.col("n") - F.col("g")).otherwise(0)).cast("long").alias("fp"), F.sum(F.when(~on, F.col("g")).otherwise(0)).cast("long").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "dice": _ratio(2 * tp, 2 * tp + fp + fn), "iou": _ratio(tp, tp + fp + fn)})


def choose_threshold(px: DataFrame, grid: Sequence[float], prob: str = "prob", fold: str = "fold", gt: str = "gt", valid: str = VALID) -> DataFrame:
    """(fold, thr, mean_iou, usable, spread): per fold the threshold of best mean IoU (lowest of equals), and what it rests on.

    ``px`` holds each fold's inner tiles; ``usable`` ones have a label. ``spread`` is the grid's best less its worst.
    """
    t = F.explode(F.array(*(F.lit(float(x)) for x in grid)))
    c = px.where(valid).groupBy(fold, "tile_id", prob).agg(F.count_if(gt).alias("g"), F.count(F.lit(1)).alias("n")).withColumn("thr", t)
    on = F.col(prob) > F.col("thr")
    s = c.groupBy(fold, "thr", "tile_id").agg(F.sum(F.when(on, F.col("g")).otherwise(0)).alias("tp"), F.sum(F.when(on, F.col("n") - F.col("g")).otherwise(0)).alias("fp"), F.sum(F.when(~on, F.col("g")).otherwise(0)).alias("fn"))
    m = s.groupBy(fold, "thr").agg(F.avg(_iou()).alias("m"), F.count_if(F.expr("tp + fn > 0")).alias("n"))
    best = F.max(F.struct(F.round("m", 9).alias("r"), (-F.col("thr")).alias("t"), F.col("m").alias("m")))
    return m.groupBy(fold).agg((-best["t"]).alias("thr"), best["m"].alias("mean_iou"), F.max("n").alias("usable"), (F.max("m") - F.min("m")).alias("spread"))


def deployment_threshold(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.avg("thr").alias("thr"), F.stddev_pop("thr").alias("spread"))


def threshold_ab(px: DataFrame, tuned: DataFrame, fixed: float = 0.5, prob: str = "prob", fold: str = "fold", gt: str = "gt", valid: str = VALID) -> DataFrame:
    """Per fold, the same predictions under the tuned threshold (fold, thr) and a fixed one, in one pass."""
    p = px.join(F.broadcast(tuned.select(fold, "thr")), fold)  # a row per fold
    n = lambda c: F.count_if(F.expr(valid) & c)
    g = F.col(gt)
    aggs = []
    for name, on in (("a", F.col(prob) > F.col("thr")), ("b", F.col(prob) > fixed)):
        aggs += [n(on & g).alias(f"tp_{name}"), n(on & ~g).alias(f"fp_{name}"), n(~on & g).alias(f"fn_{name}")]
    t = p.groupBy(fold, "tile_id").agg(*aggs).where("tp_a + fn_a > 0")
    iou = lambda x: F.avg(F.col(f"tp_{x}") / (F.col(f"tp_{x}") + F.col(f"fp_{x}") + F.col(f"fn_{x}")))
    rec = lambda x: F.avg(F.col(f"tp_{x}") / (F.col(f"tp_{x}") + F.col(f"fn_{x}")))
    out = t.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), iou("a").alias("iou_tuned"), iou("b").alias("iou_fixed"), rec("a").alias("recall_tuned"), rec("b").alias("recall_fixed"), F.count_if(F.expr("tp_a + fp_a = 0")).alias("silent_tuned"), F.count_if(F.expr("tp_b + fp_b = 0")).alias("silent_fixed"))
    return out.withColumn("delta", F.col("iou_tuned") - F.col("iou_fixed"))


# --- training logs and folds -----------------------------------------------------------------------------------


def select_epoch(log: DataFrame, min_frac: float = 0.25, margin: float = 0.005, score: str = "inner_iou") -> DataFrame:
    """(fold, epoch, score): from a quarter of the run on, an epoch replaces the best only by a margin."""
    rows = log.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("epoch", score))).alias("e"), F.max("epoch").alias("n"))  # a run's epochs
    start = F.struct(F.lit(None).cast("long").alias("epoch"), F.lit(-1e9).alias("s"))
    step = lambda a, x: F.when((x["epoch"] >= F.ceil(F.col("n") * min_frac)) & (x[score] > a["s"] + margin), F.struct(x["epoch"].alias("epoch"), x[score].alias("s"))).otherwise(a)
    return rows.withColumn("b", F.aggregate("e", start, step)).select("fold", "b.epoch", F.col("b.s").alias(score))


def convergence_check(log: DataFrame, rise: float = 1.02, min_frac: float = 0.25, margin: float = 0.005) -> DataFrame:
    """(fold, last, before, rising, epoch, at_ceiling): mean loss of the last tenth of epochs (three at least) against as many before.

    Nulls if a run hasn't twice as many epochs. ``epoch`` is the one that :func:`select_epoch` keeps; it is at the
    ceiling if it is one of the last two.
    """
    n = log.groupBy("fold").agg(F.max("epoch").alias("n")).withColumn("d", F.greatest(F.lit(3), F.floor(F.col("n") / 10)))
    x = log.join(n, "fold").withColumn("back", F.col("n") - F.col("epoch")).withColumn("long", F.col("n") >= 2 * F.col("d"))
    mean = lambda c: F.avg(F.when(F.col("long") & c, F.col("loss")))
    out = x.groupBy("fold").agg(mean(F.col("back") < F.col("d")).alias("last"), mean((F.col("back") >= F.col("d")) & (F.col("back") < 2 * F.col("d"))).alias("before"), F.max("n").alias("n"))
    out = out.join(select_epoch(log, min_frac, margin).select("fold", "epoch"), "fold")
    return out.select("fold", "last", "before", (F.col("last") > rise * F.col("before")).alias("rising"), "epoch", (F.col("epoch") >= F.col("n") - 1).alias("at_ceiling"))


def epoch_budget(checked: DataFrame) -> DataFrame:
    """(folds, at_ceiling, truncating): whether half of the folds, two at least, kept an epoch at the ceiling."""
    s = checked.agg(F.count(F.lit(1)).alias("folds"), F.count_if("at_ceiling").alias("at_ceiling"))
    return s.withColumn("truncating", F.col("at_ceiling") >= F.greatest(F.lit(2), F.floor(F.col("folds") / 2)))


def fold_health(scores: DataFrame, fold: str = "fold", metric: str = "iou", share: float = 0.4, least: float = 0.05) -> DataFrame:
    """(fold, n, mean, share, plain_mean, weighted_mean, collapsed): a fold collapses below ``share`` of the folds' median, or ``least``."""
    f = scores.where(F.col(metric).isNotNull()).groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), F.sum(metric).alias("s"))
    a = f.agg(F.avg("mean").alias("plain_mean"), (F.sum("s") / F.sum("n")).alias("weighted_mean"), F.median("mean").alias("__m"), F.sum("n").alias("__n"))  # folds are few
    collapsed = F.col("mean") < F.greatest(F.lit(least), share * F.col("__m"))
    return f.crossJoin(F.broadcast(a)).select(fold, "n", "mean", (F.col("n") / F.col("__n")).alias("share"), "plain_mean", "weighted_mean", collapsed.alias("collapsed"))  # one row


# --- rank statistics -------------------------------------------------------------------------------------------


def average_ranks(df: DataFrame, value: str, into: str) -> DataFrame:
    """``df`` with the rank of ``value`` among all rows, ties averaged: counts of equal values, summed up in order."""
    g = running_sums(df.groupBy(value).agg(F.count(F.lit(1)).alias("__n")), [value], {"__c": F.col("__n")})
    return df.join(g.select(value, (F.col("__c") - (F.col("__n") - 1) / 2).alias(into)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho, p) over rows where both are known; p from Student's t, null without spread."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    x = average_ranks(average_ranks(x, "a", "ra"), "b", "rb")
    n, sa, sb = F.count(F.lit(1)), F.sum("ra"), F.sum("rb")
    cov = n * F.sum(F.col("ra") * F.col("rb")) - sa * sb
    va, vb = n * F.sum(F.col("ra") * F.col("ra")) - sa * sa, n * F.sum(F.col("rb") * F.col("rb")) - sb * sb
    out = x.agg(n.alias("n"), (cov / F.nullif(F.sqrt(va * vb), F.lit(0.0))).alias("rho"))
    t = F.abs("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return out.withColumn("p", F.when(F.col("n") > 2, F.coalesce(student_two_sided(t, F.col("n") - 2), F.when(F.abs("rho") == 1, 0.0))))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """(n1, n2, u, z, p) of rows where ``group`` is true against false; normal with ties and continuity."""
    x = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).alias("v"), F.col(group).alias("g"))
    ties = x.groupBy("v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    s = average_ranks(x, "v", "r").agg(F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n2"), F.sum(F.when(F.col("g"), F.col("r"))).alias("s"))
    s = s.crossJoin(ties).withColumn("u", F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = (F.col("n1") + F.col("n2")).cast("double")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    d = F.col("u") - F.col("n1") * F.col("n2") / 2
    s = s.withColumn("z", F.signum(d) * F.greatest(F.lit(0.0), F.abs(d) - 0.5) / F.nullif(sd, F.lit(0.0)))
    return s.select("n1", "n2", "u", "z", normal_two_sided(F.col("z")).alias("p"))


def detection_auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """(n_pos, n_neg, roc_auc, average_precision) of a tile score; ties averaged, precision in steps of equal scores."""
    g = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("q"))
    c = running_sums(g, [F.desc(score)], {"cp": F.col("p"), "cq": F.col("q")})
    s = c.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2)).alias("above"), F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))).alias("ap"))
    return s.select(F.col("n_pos").cast("long"), F.col("n_neg").cast("long"), _ratio(F.col("above"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"), _ratio(F.col("ap"), F.col("n_pos")).alias("average_precision"))


def quartile_report(scores: DataFrame, driver: str, metric: str = "iou", silent: str = "silent", min_rows: int = 10, min_ratio: float = 1.05) -> DataFrame:
    """(quartile, n, low, high, mean, silent_share) by quartiles [low, high) of ``driver``, the last one closed.

    Nothing if there are fewer than ``min_rows`` or the largest value is less than ``min_ratio`` times the least.
    """
    x = materialize(scores.where(F.col(driver).isNotNull() & F.col(metric).isNotNull()))
    n = x.agg(F.count(F.lit(1)).alias("rows"))
    c = lambda i: F.get("c", F.lit(i))
    cut = quantiles(x, driver, (0.0, 0.25, 0.5, 0.75, 1.0), "c").crossJoin(n).where((F.col("rows") >= min_rows) & (c(4) >= min_ratio * c(0)))  # one row
    d = F.col(driver)
    q = F.when(d >= c(3), 4).when(d >= c(2), 3).when(d >= c(1), 2).otherwise(1)
    x = x.crossJoin(F.broadcast(cut)).withColumn("quartile", q)
    edge = lambda k: F.min(F.get("c", F.col("quartile") - 1 + k))
    return x.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), edge(0).alias("low"), edge(1).alias("high"), F.avg(metric).alias("mean"), F.avg(F.col(silent).cast("int")).alias("silent_share"))


def coverage_bins(scores: DataFrame, edges: Sequence[float], coverage: str = "coverage") -> DataFrame:
    """(bin, n, iou, recall, silent, iou_from_here): fixed bins [edge, next) and the mean IoU if lower bins were dropped."""
    b = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        b = F.when(F.col(coverage) >= e, i).otherwise(b)
    s = scores.where("iou is not null").withColumn("bin", b).where("bin is not null").groupBy("bin")
    s = s.agg(F.count(F.lit(1)).alias("n"), F.sum("iou").alias("s"), F.avg("iou").alias("iou"), F.avg("recall").alias("recall"), F.count_if("silent").alias("silent"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # as many rows as edges
    return s.withColumn("iou_from_here", F.sum("s").over(w) / F.sum("n").over(w)).drop("s")


def confidence_signals(px: DataFrame, prob: str = "prob", prior: str = "prior", thr: Column | float = 0.5, valid: str = VALID) -> DataFrame:
    """(tile_id, peak, decisive, agreement): label-free signals over valid pixels, 0 where there are none.

    The 99th percentile, the share farther than 0.25 from the tile's threshold ``thr``, and the IoU with the prior.
    """
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    x = px.withColumn("__t", t).withColumn("__v", F.expr(valid))
    on, v = F.col(prob) > F.col("__t"), F.col("__v")
    s = x.groupBy("tile_id").agg(F.percentile(F.when(v, F.col(prob)), F.lit(0.99)).alias("peak"), F.avg(F.when(v, (F.abs(F.col(prob) - F.col("__t")) > 0.25).cast("int"))).alias("decisive"), F.count_if(v & on & F.col(prior)).alias("i"), F.count_if(v & (on | F.col(prior))).alias("u"))
    return s.select("tile_id", *(F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((F.col("peak"), "peak"), (F.col("decisive"), "decisive"), (_ratio(F.col("i"), F.col("u")), "agreement"))))


def selective_curve(scores: DataFrame, signal: str, fracs: Sequence[float], model: str = "iou", prior: str = "prior_iou") -> DataFrame:
    """(frac, n_model, system_iou): the most confident tiles, one at least, use the model, the rest keep the prior."""
    x = row_numbers(scores.where(F.col(model).isNotNull() & F.col(prior).isNotNull()).select("tile_id", signal, model, prior), [F.desc_nulls_last(signal), "tile_id"])
    n = x.agg(F.count(F.lit(1)).alias("n"))
    x = x.crossJoin(F.broadcast(n)).withColumn("frac", F.explode(F.array(*(F.lit(float(f)) for f in fracs))))  # one row
    on = F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("frac") * F.col("n")))
    return x.groupBy("frac").agg(F.count_if(on).alias("n_model"), F.avg(F.when(on, F.col(model)).otherwise(F.col(prior))).alias("system_iou"))


def terrain_proxy(px: DataFrame) -> DataFrame:
    """(tile_id, bare): the share of pixels whose excess green is below 0.05: open ground."""
    return px.groupBy("tile_id").agg(F.avg((excess_green() < 0.05).cast("int")).alias("bare"))


def terrain_tests(tiles: DataFrame, min_group: int = 5, min_healthy: int = 20) -> DataFrame:
    """One row: does open ground explain the failures? ``tiles``: tile_id, bare, iou, silent, painted (share, healthy tiles).

    Openness against IoU (n, rho_iou, p_iou); of silent against other tiles with a label (medians, z, p_silent; null
    below ``min_group`` of either); against the painted share of healthy tiles (n_healthy, rho_painted, p_painted, and
    the means of the open and the closed half; null below ``min_healthy``).
    """
    tiles = materialize(tiles)
    scored = tiles.where("iou is not null")
    one = spearman(scored, "bare", "iou").select("n", F.col("rho").alias("rho_iou"), F.col("p").alias("p_iou"))
    medians = [quantiles(scored.where(c), "bare", [0.5]).select(F.get("q", F.lit(0)).alias(f"median_{n}")) for n, c in (("silent", "silent"), ("fired", "not silent"))]
    two = mann_whitney(scored, "bare", "silent").crossJoin(medians[0]).crossJoin(medians[1])  # one row each
    enough = (F.col("n1") >= min_group) & (F.col("n2") >= min_group)
    two = two.select(*(F.when(enough, F.col(c)).alias(n) for c, n in (("median_silent", "median_silent"), ("median_fired", "median_fired"), ("z", "z_silent"), ("p", "p_silent"))))
    healthy = tiles.where("iou is null and painted is not null")
    half = healthy.crossJoin(F.broadcast(quantiles(healthy, "bare", [0.5]))).withColumn("open", F.col("bare") >= F.get("q", F.lit(0)))
    halves = half.agg(F.avg(F.when(F.col("open"), F.col("painted"))).alias("open"), F.avg(F.when(~F.col("open"), F.col("painted"))).alias("closed"))
    three = spearman(healthy, "bare", "painted").withColumnRenamed("n", "n_healthy").crossJoin(halves)
    many = F.col("n_healthy") >= min_healthy
    three = three.select("n_healthy", *(F.when(many, F.col(c)).alias(n) for c, n in (("rho", "rho_painted"), ("p", "p_painted"), ("open", "open_painted"), ("closed", "closed_painted"))))
    return one.crossJoin(two).crossJoin(three)


def density_contrast(px: DataFrame, region: str, prob: str = "prob") -> DataFrame:
    """(tile_id, inside, outside, contrast, fired): mean probability inside a region minus outside; fired if there is any at all."""
    r = F.col(region)
    s = px.groupBy("tile_id").agg(F.avg(F.when(r, F.col(prob))).alias("inside"), F.avg(F.when(~r, F.col(prob))).alias("outside"))
    return s.withColumns({"contrast": F.col("inside") - F.col("outside"), "fired": F.coalesce(F.col("inside") + F.col("outside") > 1e-6, F.lit(False))})


def density_summary(contrast: DataFrame, margin: float = 0.02) -> DataFrame:
    """(n, fired, silent, concentrating, inside, outside, contrast): those that fired concentrate above ``margin``; medians."""
    contrast = materialize(contrast)
    s = contrast.agg(F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("fired"), F.count_if(~F.col("fired")).alias("silent"), F.count_if(F.col("fired") & (F.col("contrast") > margin)).alias("concentrating"))
    for c in ("inside", "outside", "contrast"):
        s = s.crossJoin(quantiles(contrast, c, [0.5]).select(F.get("q", F.lit(0)).alias(c)))  # one row
    return s


def zone_contrast(px: DataFrame, orig: str, corr: str) -> DataFrame:
    """(zone, pixels, greenness): corrected area, area that the correction rejected, and background."""
    zone = F.when(F.col(corr), "corrected").when(F.col(orig), "rejected").otherwise("background")
    return px.groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("pixels"), F.avg(ngrdi()).alias("greenness"))


def paired_improvement(a: DataFrame, b: DataFrame, metric: str = "iou") -> DataFrame:
    """(n, median_a, median_b, mean_a, mean_b, improved): two models on the same tiles."""
    x = a.select("tile_id", F.col(metric).alias("a")).join(b.select("tile_id", F.col(metric).alias("b")), "tile_id").where("a is not null and b is not null")
    x = materialize(x)
    s = x.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count_if(F.expr("b > a")).alias("improved"))
    for c in ("a", "b"):
        s = s.crossJoin(quantiles(x, c, [0.5]).select(F.get("q", F.lit(0)).alias(f"median_{c}")))  # one row
    return s


def dice_focal(px: DataFrame, prob: str = "prob", gt: str = "gt", valid: str = VALID, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """(tile_id, n, dice_loss, focal, total) over valid pixels. ``alpha`` scales the whole focal term, whatever the class."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    g = F.col(gt)
    pt = F.when(g, p).otherwise(1 - p)
    t = px.where(valid).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(g, F.col(prob)).otherwise(0.0)).alias("i"), F.sum(prob).alias("sp"), F.count_if(g).alias("sg"), F.avg(alpha * F.pow(1 - pt, F.lit(gamma)) * -F.log(pt)).alias("focal"))
    t = t.withColumn("dice_loss", 1 - (2 * F.col("i") + 1) / (F.col("sp") + F.col("sg") + 1))
    return t.select("tile_id", "n", "dice_loss", "focal", (F.col("dice_loss") + F.col("focal")).alias("total"))


def dice_focal_overall(per_tile: DataFrame) -> DataFrame:
    """(tiles, dice_loss, focal, total): Dice averaged over tiles, the focal term over all their pixels."""
    s = per_tile.agg(F.count(F.lit(1)).alias("tiles"), F.avg("dice_loss").alias("dice_loss"), _ratio(F.sum(F.col("focal") * F.col("n")), F.sum("n")).alias("focal"))
    return s.withColumn("total", F.col("dice_loss") + F.col("focal"))


def affine_errors(pairs: DataFrame, width: int = 384, height: int = 384) -> DataFrame:
    """(pair_id, regime, corner_px, shift_px, turn_deg, scale, shear_deg, idle_px): predicted against true affines.

    Affines (g*, p*) are in units where the raster is [-1, 1]. The shift averages |dx| and |dy|, the scale the errors of
    both diagonal entries; turns wrap at 180 degrees; shear is the angle whose tangent is b. ``idle_px`` is the corner
    error of doing nothing. Nine points: corners, middles of sides, centre.
    """
    pts = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1))))
    at = lambda m: (F.col(f"{m}a") * F.col("q.x") + F.col(f"{m}b") * F.col("q.y") + F.col(f"{m}tx"), F.col(f"{m}c") * F.col("q.x") + F.col(f"{m}d") * F.col("q.y") + F.col(f"{m}ty"))
    far = lambda a, b: F.sqrt(F.pow((a[0] - b[0]) * width / 2, F.lit(2)) + F.pow((a[1] - b[1]) * height / 2, F.lit(2)))
    x = pairs.withColumn("q", pts)
    x = x.groupBy("pair_id").agg(F.avg(far(at("g"), at("p"))).alias("corner_px"), F.avg(far(at("g"), (F.col("q.x"), F.col("q.y")))).alias("idle_px"))

    g, p = ({k: F.col(f"{m}{k}") for k in ("a", "b", "c", "d", "tx", "ty")} for m in "gp")
    turn = F.degrees(F.atan2(p["c"], p["a"])) - F.degrees(F.atan2(g["c"], g["a"]))
    one = pairs.select(
        "pair_id", "regime", ((F.abs(g["tx"] - p["tx"]) * width / 2 + F.abs(g["ty"] - p["ty"]) * height / 2) / 2).alias("shift_px"),
        F.abs(F.pmod(turn + 180, F.lit(360.0)) - 180).alias("turn_deg"), ((F.abs(p["a"] - g["a"]) + F.abs(p["d"] - g["d"])) / 2).alias("scale"), F.abs(F.degrees(F.atan(p["b"]) - F.atan(g["b"]))).alias("shear_deg"),
    )
    return one.join(x, "pair_id")


def recoverability(errors: DataFrame, by: str = "regime", magnitude: str = "idle_px", left: float = 0.4, partial: float = 0.3) -> DataFrame:
    """(regime, n, error, idle, closed, verdict, largest): how much of the do-nothing error is closed, and how far it reaches.

    Recovered means that less than ``left`` of the error of doing nothing remains, for the mean as for the largest
    ``magnitude``; more than ``partial`` closed is partly recovered.
    """
    s = errors.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("corner_px").alias("error"), F.avg("idle_px").alias("idle"), F.max(F.when(F.col("corner_px") < left * F.col("idle_px"), F.col(magnitude))).alias("largest"))
    s = s.withColumn("closed", 1 - F.col("error") / F.greatest(F.col("idle"), F.lit(1e-9)))
    return s.withColumn("verdict", F.when(F.col("error") < left * F.col("idle"), "recovered").when(F.col("closed") > partial, "partial").otherwise("not recovered"))
