"""Queries of splits, the pixel classifier, evaluation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from standmap.operators import evaluate as ev
from standmap.operators import learn, report, splits
from standmap.operators.raster import label_coverage
from standmap.plans.rasters import _box_sql, _morph, blobs_sql
from standmap.plans.registry import query
from standmap.plans.tables import RAND
from standmap.sources import io
from standmap.sources.fixtures import Views

R = lambda c, n=6: F.round(c, n)
HOT = "prob > 0.5"
V = "(gt OR NOT ign)"


def rounded(df, *keep: str, n: int = 6):
    """``df`` with its doubles rounded."""
    return df.select(*((R(c, n).alias(c) if k == "double" and c not in keep else F.col(c)) for c, k in df.dtypes))


def counts(pred: str, by: str = "tile_id", source: str = "pixels", into: str = "c") -> str:
    return f"{into} AS (SELECT {by}, count(*) FILTER ({V} AND {pred} AND gt) AS tp, count(*) FILTER ({V} AND {pred} AND NOT gt) AS fp, count(*) FILTER ({V} AND NOT ({pred}) AND gt) AS fn, count(*) FILTER {'(' + V + ')'} AS n FROM {source} GROUP BY {by})"


IOU = "CASE WHEN tp + fn > 0 THEN tp / (tp + fp + fn) END"
DICE = "CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END"


# --- splits ----------------------------------------------------------------------------------------------------


@query()
def spatial_clusters(v: Views):
    out = splits.spatial_clusters(v.poly.select("poly_id", "cx", "cy"), 6, (1, 2))
    return out.select("poly_id", "area_cluster")


@query()
def spatial_folds(v: Views):
    t = v.tiles.withColumn("lon", F.when(F.col("source_id") % 40 != 0, F.col("lon")))
    return splits.spatial_folds(t, "source_id").select("tile_id", "source_id", "fold", "spatial")


@query("tiles", f"SELECT tile_id, CAST(ntile(7) OVER (ORDER BY {RAND.format(id='tile_id')}, tile_id) AS INT) AS fold FROM tiles")
def random_folds(v: Views):
    return splits.random_folds(v.tiles.select("tile_id"), 7, 42)


@query("tiles", f"WITH g AS (SELECT DISTINCT source_id FROM tiles), h AS (SELECT source_id, row_number() OVER (ORDER BY {RAND.format(id='source_id')}, source_id) AS r, count(*) OVER () AS n FROM g) SELECT tile_id, source_id, CASE WHEN r <= greatest(1, round_even(0.15 * n, 0)) THEN 'val' ELSE 'train' END AS part FROM tiles JOIN h USING (source_id)")
def group_holdout(v: Views):
    return splits.group_holdout(v.tiles.select("tile_id", "source_id"), "source_id")


@query("tiles", f"WITH f AS (SELECT tile_id, tile_id % 5 AS fold FROM tiles), t AS (SELECT o.fold AS outer_fold, tile_id, row_number() OVER (PARTITION BY o.fold ORDER BY {RAND.format(id='tile_id')}, tile_id) AS r, count(*) OVER (PARTITION BY o.fold) AS n FROM f, (SELECT DISTINCT fold FROM f) o WHERE f.fold <> o.fold) SELECT outer_fold, tile_id, r <= greatest(4, CAST(round_even(n * 0.15, 0) AS BIGINT)) AS inner FROM t".replace(" AS inner", ' AS "inner"'))
def nested_inner_split(v: Views):
    return splits.nested_inner_split(v.tiles.selectExpr("tile_id", "tile_id % 5 as fold"))


@query("tiles", "SELECT source_id, count(DISTINCT tile_id % 5) AS folds FROM tiles GROUP BY source_id HAVING count(DISTINCT tile_id % 5) > 1")
def leakage_check(v: Views):
    return splits.leakage_check(v.tiles.selectExpr("source_id", "tile_id % 5 as fold"), "source_id")


# --- the pixel classifier --------------------------------------------------------------------------------------


FEATURES_SQL = _box_sql("(r/255.0::DOUBLE + g/255.0::DOUBLE + b/255.0::DOUBLE)/3", 9)


@query("pixels", f"WITH {FEATURES_SQL}, p AS (SELECT pixels.*, r/255.0::DOUBLE AS rr, g/255.0::DOUBLE AS gg, nir/255.0::DOUBLE AS nn, sqrt(greatest(0.0, q - m*m)) AS t FROM pixels JOIN boxed USING (tile_id, y, x)) SELECT tile_id, round(avg(r), 4) AS r, round(avg(g), 4) AS g, round(avg(b), 4) AS b, round(avg((nn-rr)/(nn+rr+1e-3)), 4) AS ndvi, round(avg((rr-gg)/(rr+gg+1e-3)), 4) AS redness, round(avg((rr+gg+b/255.0::DOUBLE)/3), 4) AS brightness, round(avg(t), 4) AS texture FROM p GROUP BY tile_id")
def pixel_features(v: Views):
    out = learn.pixel_features(v.pixels)
    return out.groupBy("tile_id").agg(*(R(F.avg(c), 4).alias(c) for c in learn.FEATURES))


def _features(v: Views):
    return learn.pixel_features(v.pixels)


@query()
def pixel_classifier(v: Views):
    even, odd = (learn.pixel_features(v.pixels.where(f"tile_id % 2 = {i}")) for i in (0, 1))
    scored = learn.pixel_classifier(even, odd)
    return rounded(scored.groupBy("tile_id").agg(F.avg(F.when(F.col("gt"), F.col("score"))).alias("inside"), F.avg(F.when(~F.col("gt"), F.col("score"))).alias("outside")), n=4)


@query()
def leave_one_out_score(v: Views):
    return learn.leave_one_out_score(_features(v), max_tiles=None, per_class=None, folds=4, draws=4)


@query()
def learned_drafts(v: Views):
    return learn.learned_drafts(_features(v), v.annotations.where("version = '6.3.1'").select("tile_id").distinct(), per_class=None)


@query("pixels", "SELECT tile_id, round(avg(prob), 6) AS mean, CAST(sum(r) AS BIGINT) AS r FROM pixels GROUP BY tile_id")
def score_tiles(v: Views):
    def summary(pdf):
        import pandas as pd

        return pd.DataFrame({"tile_id": [pdf["tile_id"].iloc[0]], "mean": [pdf["prob"].mean()], "r": [int(pdf["r"].sum())]})

    return rounded(learn.score_tiles(v.pixels.select("tile_id", "y", "x", "prob", "r"), summary, "tile_id long, mean double, r long"))


# --- evaluation ------------------------------------------------------------------------------------------------


@query("pixels", f"WITH {counts(HOT)} SELECT tile_id, round({IOU}, 6) AS iou, round({DICE}, 6) AS dice FROM c")
def iou_dice(v: Views):
    return rounded(ev.iou_dice(v.pixels, HOT))


@query("pixels", f"WITH h AS (SELECT tile_id, y, x, prob > 0.5 AS m FROM pixels), {_morph('h', 'a', 'dilate', 'square', 4)}, {_morph('a', 'b', 'dilate', 'square', 4)}, {_morph('b', 'd', 'erode', 'square', 4)}, j AS (SELECT p.*, d.m FROM pixels p JOIN d USING (tile_id, y, x)), {counts('m', source='j')} SELECT tile_id, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END, 6) AS iou FROM c")
def region_iou(v: Views):
    return rounded(ev.region_iou(v.pixels, HOT))


@query("pixels", f"WITH {counts(HOT, '1')} SELECT tp, fp, fn, round(tp/(tp+fp+fn), 6) AS iou, round(2*tp/(2*tp+fp+fn), 6) AS dice, round(tp/(tp+fp), 6) AS precision, round(tp/(tp+fn), 6) AS recall FROM c")
def confusion_micro(v: Views):
    return rounded(ev.confusion_micro(v.pixels, HOT))


@query("pixels", f"WITH {counts(HOT)} SELECT count(*) FILTER (tp+fn > 0) AS n_damage, round(avg({DICE}), 6) AS dice, round(avg(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) END), 6) AS recall, round(sum(CASE WHEN tp+fn = 0 THEN fp END) / sum(CASE WHEN tp+fn = 0 THEN n END), 6) AS false_positive_rate FROM c")
def macro_scores(v: Views):
    return rounded(ev.macro_scores(v.pixels, HOT))


@query("pixels", f"WITH RECURSIVE {blobs_sql('gt')}, t AS (SELECT b.tile_id, blob, bool_or(prob > 0.5) AS hit FROM blobs b JOIN pixels USING (tile_id, y, x) GROUP BY 1, 2) SELECT count(*) AS blobs, count(*) FILTER (hit) AS touched, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM t")
def object_recall(v: Views):
    return rounded(ev.object_recall(v.pixels, HOT))


@query("pixels", f"WITH {counts(HOT)} SELECT tile_id, round(tp/(tp+fn), 6) AS recall, round(tp/nullif(tp+fp, 0), 6) AS precision, round((tp+fp)/(tp+fn), 6) AS area_ratio, tp+fp = 0 AS silent, coalesce(tp/(tp+fn) > 0.95 AND tp/nullif(tp+fp, 0) < 0.1, false) AS paints_all FROM c WHERE tp+fn > 0")
def recall_precision(v: Views):
    return rounded(ev.recall_precision(v.pixels, HOT))


BASE = f"WITH {counts(HOT, into='a')}, {counts('prior', into='b')}, {counts('prob > 0.25', into='z')}, m AS (SELECT (SELECT avg({IOU}) FROM a) AS model, (SELECT avg({IOU}) FROM b) AS prior_echo, (SELECT avg({IOU}) FROM z) AS zero_shot)"


@query("pixels", BASE + " SELECT round(model, 6) AS model, round(prior_echo, 6) AS prior_echo, round(zero_shot, 6) AS zero_shot, round(model - prior_echo, 6) AS gain_prior, round(model - zero_shot, 6) AS gain_zero FROM m")
def baselines(v: Views):
    return rounded(ev.baselines(v.pixels, HOT, "prior", "prob > 0.25"))


@query("pixels", f"WITH c AS (SELECT tile_id, count(*) FILTER (gt AND {V}) AS g, count(*) FILTER (prob > 0.5 AND {V}) AS p, count(*) FILTER (prior AND {V}) AS q, count(*) FILTER ({V}) AS n FROM pixels GROUP BY tile_id) SELECT count(*) AS tiles, round(avg(p/n), 6) AS painted, round(avg(q/n), 6) AS prior_painted, round(max(p/n), 6) AS worst FROM c WHERE g = 0 AND n > 0")
def commission(v: Views):
    return rounded(ev.commission(v.pixels, HOT, "prior"))


@query("pixels", f"WITH {counts(HOT)}, i AS (SELECT source_id, {IOU} AS iou FROM c JOIN tiles USING (tile_id)), s AS (SELECT source_id, avg(iou) AS m, count(*) AS n FROM i WHERE iou IS NOT NULL GROUP BY 1) SELECT count(*) AS sources, CAST(sum(n) AS BIGINT) AS crops, round(avg(m), 6) AS mean_of_means, round(avg(n), 6) AS mean_crops FROM s")
def per_source_mean(v: Views):
    s = ev.iou_dice(v.pixels, HOT).join(v.tiles.select("tile_id", "source_id"), "tile_id")
    return rounded(ev.per_source_mean(s, "source_id"))


GRID = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
THR = "(SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS thr)"


@query("pixels", f"WITH c AS (SELECT thr, count(*) FILTER (prob > thr AND gt) AS tp, count(*) FILTER (prob > thr AND NOT gt) AS fp, count(*) FILTER (NOT prob > thr AND gt) AS fn FROM pixels, {THR} WHERE {V} GROUP BY thr) SELECT thr, tp, fp, fn, round(tp/nullif(tp+fp, 0), 6) AS precision, round(tp/nullif(tp+fn, 0), 6) AS recall, round(2*tp/nullif(2*tp+fp+fn, 0), 6) AS dice, round(tp/nullif(tp+fp+fn, 0), 6) AS iou FROM c")
def threshold_sweep(v: Views):
    return rounded(ev.threshold_sweep(v.pixels, "prob", GRID), "thr")


INNER = f"""tr AS (SELECT o.fold, tile_id, row_number() OVER (PARTITION BY o.fold ORDER BY {RAND.format(id='tile_id')}, tile_id) AS r, count(*) OVER (PARTITION BY o.fold) AS n FROM tiles, (SELECT DISTINCT tile_id % 5 AS fold FROM tiles) o WHERE tile_id % 5 <> o.fold),
inn AS (SELECT fold, tile_id FROM tr WHERE r <= greatest(4, CAST(round_even(n * 0.15, 0) AS BIGINT)))"""
CHOOSE = f"""{INNER}, c AS (SELECT fold, thr, tile_id, count(*) FILTER (prob > thr AND gt) AS tp, count(*) FILTER (prob > thr AND NOT gt) AS fp, count(*) FILTER (NOT prob > thr AND gt) AS fn FROM pixels JOIN inn USING (tile_id), {THR} WHERE {V} GROUP BY 1, 2, 3),
m AS (SELECT fold, thr, avg({IOU}) AS m, count(*) FILTER (tp + fn > 0) AS n FROM c GROUP BY 1, 2),
b AS (SELECT fold, thr, m AS mean_iou FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(m, 9) DESC, thr) = 1),
u AS (SELECT fold, max(n) AS usable, max(m) - min(m) AS spread FROM m GROUP BY fold)"""


def _folded(v: Views):
    return v.pixels.withColumn("fold", F.col("tile_id") % 5)


def _inner(v: Views):
    """Pixels of each fold's inner tiles: those of its training tiles that choose the threshold."""
    inner = splits.nested_inner_split(v.tiles.selectExpr("tile_id", "tile_id % 5 as fold")).where("inner").select(F.col("outer_fold").alias("fold"), "tile_id")
    return v.pixels.join(inner, "tile_id")


@query("tiles pixels", f"WITH {CHOOSE} SELECT fold, thr, round(mean_iou, 6) AS mean_iou, usable, round(spread, 6) AS spread FROM b JOIN u USING (fold)")
def choose_threshold(v: Views):
    return rounded(ev.choose_threshold(_inner(v), GRID), "thr")


@query("tiles pixels", f"WITH {CHOOSE}, t AS (SELECT b.fold, tile_id, count(*) FILTER ({V} AND prob > thr AND gt) AS tpa, count(*) FILTER ({V} AND prob > thr AND NOT gt) AS fpa, count(*) FILTER ({V} AND NOT prob > thr AND gt) AS fna, count(*) FILTER ({V} AND prob > 0.5 AND gt) AS tpb, count(*) FILTER ({V} AND prob > 0.5 AND NOT gt) AS fpb, count(*) FILTER ({V} AND NOT prob > 0.5 AND gt) AS fnb FROM pixels JOIN b ON tile_id % 5 = fold GROUP BY 1, 2) SELECT fold, count(*) AS n, round(avg(tpa/(tpa+fpa+fna)), 6) AS iou_tuned, round(avg(tpb/(tpb+fpb+fnb)), 6) AS iou_fixed, round(avg(tpa/(tpa+fna)), 6) AS recall_tuned, round(avg(tpb/(tpb+fnb)), 6) AS recall_fixed, count(*) FILTER (tpa+fpa = 0) AS silent_tuned, count(*) FILTER (tpb+fpb = 0) AS silent_fixed, round(avg(tpa/(tpa+fpa+fna)) - avg(tpb/(tpb+fpb+fnb)), 6) AS delta FROM t WHERE tpa + fna > 0 GROUP BY fold")
def threshold_ab(v: Views):
    return rounded(ev.threshold_ab(_folded(v), ev.choose_threshold(_inner(v), GRID)))


EPOCH = """n AS (SELECT fold, max(epoch) AS n FROM epochs GROUP BY fold),
w AS (SELECT fold, 0::BIGINT AS e, NULL::BIGINT AS epoch, -1e9::DOUBLE AS s FROM n UNION ALL SELECT w.fold, w.e + 1, CASE WHEN x.epoch >= ceil(n.n * 0.25) AND x.inner_iou > w.s + 0.005 THEN x.epoch ELSE w.epoch END, CASE WHEN x.epoch >= ceil(n.n * 0.25) AND x.inner_iou > w.s + 0.005 THEN x.inner_iou ELSE w.s END FROM w JOIN n USING (fold) JOIN epochs x ON x.fold = w.fold AND x.epoch = w.e + 1)"""


@query("epochs", f"WITH RECURSIVE {EPOCH} SELECT fold, epoch, round(s, 6) AS inner_iou FROM w WHERE e = 60")
def select_epoch(v: Views):
    return rounded(ev.select_epoch(v.epochs))


@query("epochs", f"WITH RECURSIVE {EPOCH}, a AS (SELECT fold, avg(CASE WHEN n.n - epochs.epoch < greatest(3, n.n // 10) THEN loss END) AS last, avg(CASE WHEN n.n - epochs.epoch >= greatest(3, n.n // 10) AND n.n - epochs.epoch < 2 * greatest(3, n.n // 10) THEN loss END) AS before, max(n.n) AS n FROM epochs JOIN n USING (fold) GROUP BY fold) SELECT fold, round(last, 6) AS last, round(before, 6) AS before, last > 1.02 * before AS rising, w.epoch, w.epoch >= a.n - 1 AS at_ceiling FROM a JOIN w USING (fold) WHERE e = 60")
def convergence_check(v: Views):
    return rounded(ev.convergence_check(v.epochs))


@query("pixels", f"WITH {counts(HOT)}, s AS (SELECT tile_id % 5 AS fold, {IOU} AS iou FROM c), f AS (SELECT fold, count(*) AS n, avg(iou) AS mean, sum(iou) AS s FROM s WHERE iou IS NOT NULL GROUP BY fold), a AS (SELECT avg(mean) AS p, sum(s)/sum(n) AS w, median(mean) AS m, sum(n) AS t FROM f) SELECT fold, n, round(mean, 6) AS mean, round(n/t, 6) AS share, round(p, 6) AS plain_mean, round(w, 6) AS weighted_mean, mean < greatest(0.05, 0.4*m) AS collapsed FROM f, a")
def fold_health(v: Views):
    return rounded(ev.fold_health(ev.iou_dice(v.pixels, HOT).withColumn("fold", F.col("tile_id") % 5)))


TILE = f"""{counts(HOT)}, {counts('prior', into='pc')}, ti AS (SELECT tile_id, {IOU} AS iou, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) END AS recall, tp+fp = 0 AS silent FROM c),
pi AS (SELECT tile_id, {IOU} AS prior_iou FROM pc), cv AS (SELECT tile_id, count(*) FILTER (gt) / nullif(count(*) - count(*) FILTER (ign AND NOT gt), 0) AS coverage, max(prob) AS peak, bool_or(gt) AS damaged FROM pixels GROUP BY tile_id),
tm AS (SELECT * FROM ti JOIN pi USING (tile_id) JOIN cv USING (tile_id) JOIN (SELECT tile_id, window_m, dca, role FROM tiles) USING (tile_id))"""


def _tiles(v: Views):
    """Per tile: iou, recall, silent, prior_iou, coverage, peak, damaged, window_m, dca, role."""
    px = v.pixels
    t = ev.tile_scores(px, HOT)
    p = ev.iou_dice(px, "prior").select("tile_id", F.col("iou").alias("prior_iou"))
    c = label_coverage(px).select("tile_id", "coverage")
    k = px.groupBy("tile_id").agg(F.max("prob").alias("peak"), F.bool_or("gt").alias("damaged"))
    return io.tile_metrics_table(t, p, c, k, v.tiles.select("tile_id", "window_m", "dca", "role"))


@query("pixels", f"WITH {TILE} SELECT tile_id, round(iou, 6) AS iou, round(recall, 6) AS recall, silent, round(prior_iou, 6) AS prior_iou, round(coverage, 6) AS coverage, round(peak, 6) AS peak, damaged, window_m, dca, role FROM tm")
def tile_metrics_table(v: Views):
    return rounded(_tiles(v))


@query("pixels", f"WITH {TILE}, p AS (SELECT count(*) FILTER (damaged) AS np, count(*) FILTER (NOT damaged) AS nn FROM tm), u AS (SELECT sum(CASE WHEN a.peak > b.peak THEN 1.0 WHEN a.peak = b.peak THEN 0.5 ELSE 0.0 END) AS u FROM tm a, tm b WHERE a.damaged AND NOT b.damaged), g AS (SELECT peak, count(*) FILTER (damaged) AS p, count(*) AS n FROM tm GROUP BY peak), h AS (SELECT p, sum(p) OVER (ORDER BY peak DESC) AS cp, sum(n) OVER (ORDER BY peak DESC) AS cn FROM g) SELECT np AS n_pos, nn AS n_neg, round(u/(np*nn), 6) AS roc_auc, round((SELECT sum(p*cp/cn) FROM h)/np, 6) AS average_precision FROM p, u")
def detection_auc(v: Views):
    return rounded(ev.detection_auc(_tiles(v), "peak", "damaged"))


def ranks(a: str, source: str, into: str) -> str:
    return f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS {into}"


@query("pixels", f"WITH {TILE}, x AS (SELECT {ranks('iou', '', 'ra')}, {ranks('window_m', '', 'rb')} FROM tm WHERE iou IS NOT NULL) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM x")
def spearman(v: Views):
    return rounded(ev.spearman(_tiles(v), "iou", "window_m").drop("p"))


@query("pixels", f"WITH {TILE}, x AS (SELECT peak, damaged, {ranks('peak', '', 'r')}, count(*) OVER (PARTITION BY peak) AS t FROM tm), s AS (SELECT count(*) FILTER (damaged) AS n1, count(*) FILTER (NOT damaged) AS n2, sum(r) FILTER (damaged) AS s, sum(t*t - 1) AS ties, CAST(count(*) AS DOUBLE) AS n FROM x), w AS (SELECT n1, n2, s - n1*(n1+1)/2 AS u, sqrt(n1*n2/12.0::DOUBLE*(n + 1 - ties/(n*(n-1)))) AS sd FROM s) SELECT n1, n2, u, round(sign(u - n1*n2/2)*greatest(0.0, abs(u - n1*n2/2) - 0.5)/sd, 6) AS z FROM w")
def mann_whitney(v: Views):
    return rounded(ev.mann_whitney(_tiles(v), "peak", "damaged").drop("p"))


@query("pixels", f"WITH {TILE}, x AS (SELECT * FROM tm WHERE iou IS NOT NULL), q AS (SELECT quantile_cont(window_m, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c, count(*) AS rows FROM x), y AS (SELECT *, CASE WHEN window_m >= c[4] THEN 4 WHEN window_m >= c[3] THEN 3 WHEN window_m >= c[2] THEN 2 ELSE 1 END AS quartile FROM x, q WHERE rows >= 10 AND c[5] >= 1.05 * c[1]) SELECT quartile, count(*) AS n, round(any_value(c[quartile]), 6) AS low, round(any_value(c[quartile + 1]), 6) AS high, round(avg(iou), 6) AS mean, round(avg(CASE WHEN silent THEN 1 ELSE 0 END), 6) AS silent_share FROM y GROUP BY 1")
def quartile_report(v: Views):
    return rounded(ev.quartile_report(_tiles(v), "window_m"))


@query("pixels", f"WITH {TILE}, b AS (SELECT CASE WHEN coverage >= 0.1 THEN 3 WHEN coverage >= 0.05 THEN 2 WHEN coverage >= 0.02 THEN 1 WHEN coverage >= 0 THEN 0 END AS bin, iou, recall, silent FROM tm WHERE iou IS NOT NULL), g AS (SELECT bin, count(*) AS n, sum(iou) AS s, avg(iou) AS iou, avg(recall) AS recall, count(*) FILTER (silent) AS silent FROM b WHERE bin IS NOT NULL GROUP BY bin) SELECT bin, n, round(iou, 6) AS iou, round(recall, 6) AS recall, silent, round(sum(s) OVER w / sum(n) OVER w, 6) AS iou_from_here FROM g WINDOW w AS (ORDER BY bin DESC)")
def coverage_bins(v: Views):
    return rounded(ev.coverage_bins(_tiles(v), (0.0, 0.02, 0.05, 0.1)))


@query("tiles pixels", f"WITH {CHOOSE}, p AS (SELECT pixels.*, thr, {V} AS v FROM pixels JOIN b ON tile_id % 5 = fold) SELECT tile_id, round(coalesce(quantile_cont(prob, 0.99) FILTER (v), 0), 6) AS peak, round(coalesce(avg(CASE WHEN abs(prob - thr) > 0.25 THEN 1 ELSE 0 END) FILTER (v), 0), 6) AS decisive, round(coalesce(count(*) FILTER (v AND prob > thr AND prior) / nullif(count(*) FILTER (v AND (prob > thr OR prior)), 0), 0), 6) AS agreement FROM p GROUP BY tile_id")
def confidence_signals(v: Views):
    px = _folded(v).join(F.broadcast(ev.choose_threshold(_inner(v), GRID).select("fold", "thr")), "fold")  # a row per fold
    return rounded(ev.confidence_signals(px, thr=F.col("thr")))


@query("pixels", f"WITH {TILE}, x AS (SELECT *, row_number() OVER (ORDER BY peak DESC NULLS LAST, tile_id) AS rn, count(*) OVER () AS n FROM tm WHERE iou IS NOT NULL AND prior_iou IS NOT NULL), f AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS frac) SELECT frac, count(*) FILTER (rn <= greatest(1, round_even(frac*n, 0))) AS n_model, round(avg(CASE WHEN rn <= greatest(1, round_even(frac*n, 0)) THEN iou ELSE prior_iou END), 6) AS system_iou FROM x, f GROUP BY frac")
def selective_curve(v: Views):
    return rounded(ev.selective_curve(_tiles(v), "peak", (0.1, 0.25, 0.5, 0.75, 1.0)), "frac")


BARE = "bare AS (SELECT tile_id, avg(CASE WHEN 2*(g/255.0::DOUBLE) - r/255.0::DOUBLE - b/255.0::DOUBLE < 0.05 THEN 1 ELSE 0 END) AS bare, count(*) FILTER (prob > 0.5 AND (gt OR NOT ign)) / nullif(count(*) FILTER (gt OR NOT ign), 0) AS painted FROM pixels GROUP BY tile_id)"


@query("pixels", f"""WITH {TILE}, {BARE}, t AS (SELECT * FROM tm JOIN bare USING (tile_id)), s AS (SELECT *, {ranks('bare', '', 'rb')}, {ranks('iou', '', 'ri')}, count(*) OVER (PARTITION BY bare) AS tie FROM t WHERE iou IS NOT NULL),
a AS (SELECT count(*) AS n, corr(rb, ri) AS rho, median(bare) FILTER (silent) AS m1, median(bare) FILTER (NOT silent) AS m2, count(*) FILTER (silent) AS n1, count(*) FILTER (NOT silent) AS n2, sum(rb) FILTER (silent) AS sr, sum(tie*tie - 1) AS ties, CAST(count(*) AS DOUBLE) AS k FROM s),
z AS (SELECT *, sr - n1*(n1+1)/2 - n1*n2/2 AS d, sqrt(n1*n2/12.0::DOUBLE*(k + 1 - ties/(k*(k-1)))) AS sd FROM a),
h AS (SELECT *, {ranks('bare', '', 'rb')}, {ranks('painted', '', 'rp')}, median(bare) OVER () AS m FROM t WHERE iou IS NULL AND painted IS NOT NULL),
e AS (SELECT count(*) AS n_healthy, corr(rb, rp) AS rho, avg(painted) FILTER (bare >= m) AS op, avg(painted) FILTER (bare < m) AS cl FROM h)
SELECT z.n, round(z.rho, 6) AS rho_iou, round(CASE WHEN n1 >= 5 AND n2 >= 5 THEN m1 END, 6) AS median_silent, round(CASE WHEN n1 >= 5 AND n2 >= 5 THEN m2 END, 6) AS median_fired, round(CASE WHEN n1 >= 5 AND n2 >= 5 THEN sign(d)*greatest(0.0, abs(d) - 0.5)/nullif(sd, 0) END, 6) AS z_silent,
 n_healthy, round(CASE WHEN n_healthy >= 20 THEN e.rho END, 6) AS rho_painted, round(CASE WHEN n_healthy >= 20 THEN op END, 6) AS open_painted, round(CASE WHEN n_healthy >= 20 THEN cl END, 6) AS closed_painted FROM z, e""")
def terrain_proxy(v: Views):
    px = v.pixels
    painted = px.groupBy("tile_id").agg((F.count_if(F.expr(f"{V} and {HOT}")) / F.nullif(F.count_if(F.expr(V)), F.lit(0))).alias("painted"))
    tiles = ev.tile_scores(px, HOT).join(ev.terrain_proxy(px), "tile_id").join(painted, "tile_id")
    return rounded(ev.terrain_tests(tiles).drop("p_iou", "p_silent", "p_painted"))


@query("pixels", "WITH c AS (SELECT avg(prob) FILTER (prior) AS inside, avg(prob) FILTER (NOT prior) AS outside FROM pixels GROUP BY tile_id), d AS (SELECT *, inside - outside AS contrast, coalesce(inside + outside > 1e-6, false) AS fired FROM c) SELECT count(*) AS n, count(*) FILTER (fired) AS fired, count(*) FILTER (NOT fired) AS silent, count(*) FILTER (fired AND contrast > 0.02) AS concentrating, round(median(inside), 9) AS inside, round(median(outside), 9) AS outside, round(median(contrast), 9) AS contrast FROM d")
def density_contrast(v: Views):
    return rounded(ev.density_summary(ev.density_contrast(v.pixels, "prior")), n=9)


@query("pixels", "SELECT CASE WHEN gt THEN 'corrected' WHEN prior THEN 'rejected' ELSE 'background' END AS zone, count(*) AS pixels, round(avg((g/255.0::DOUBLE - r/255.0::DOUBLE)/(g/255.0::DOUBLE + r/255.0::DOUBLE + 1e-6)), 6) AS greenness FROM pixels GROUP BY 1")
def zone_contrast(v: Views):
    return rounded(ev.zone_contrast(v.pixels, "prior", "gt"))


@query("pixels", f"WITH {TILE}, x AS (SELECT prior_iou AS a, iou AS b FROM tm WHERE iou IS NOT NULL AND prior_iou IS NOT NULL) SELECT count(*) AS n, round(median(a), 6) AS median_a, round(median(b), 6) AS median_b, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(*) FILTER (b > a) AS improved FROM x")
def paired_improvement(v: Views):
    return rounded(ev.paired_improvement(ev.iou_dice(v.pixels, "prior"), ev.iou_dice(v.pixels, HOT)))


@query("pixels", f"WITH p AS (SELECT tile_id, gt, prob, least(greatest(prob, 1e-6), 1 - 1e-6) AS q FROM pixels WHERE {V}), t AS (SELECT tile_id, sum(CASE WHEN gt THEN prob ELSE 0 END) AS i, sum(prob) AS sp, count(*) FILTER (gt) AS sg, count(*) AS n, avg(CASE WHEN gt THEN 0.25 * pow(1 - q, 2) * -ln(q) ELSE 0.25 * pow(q, 2) * -ln(1 - q) END) AS focal FROM p GROUP BY tile_id) SELECT tile_id, n, round(1 - (2*i + 1)/(sp + sg + 1), 5) AS dice_loss, round(focal, 5) AS focal, round(1 - (2*i + 1)/(sp + sg + 1) + focal, 5) AS total FROM t")
def dice_focal(v: Views):
    return rounded(ev.dice_focal(v.pixels), n=5)


AFF = """q AS (SELECT a.v AS x, b.v AS y FROM (SELECT unnest([-1.0, 0.0, 1.0]::DOUBLE[]) AS v) a, (SELECT unnest([-1.0, 0.0, 1.0]::DOUBLE[]) AS v) b),
e AS (SELECT pair_id, avg(192*sqrt(pow((ga-pa)*x + (gb-pb)*y + gtx-ptx, 2) + pow((gc-pc)*x + (gd-pd)*y + gty-pty, 2))) AS corner_px, avg(192*sqrt(pow((ga-1)*x + gb*y + gtx, 2) + pow(gc*x + (gd-1)*y + gty, 2))) AS idle_px FROM affine_pairs, q GROUP BY pair_id),
o AS (SELECT pair_id, regime, 192*(abs(gtx-ptx) + abs(gty-pty))/2 AS shift_px, least(abs(degrees(atan2(gc, ga) - atan2(pc, pa))), 360 - abs(degrees(atan2(gc, ga) - atan2(pc, pa)))) AS turn_deg, (abs(ga - pa) + abs(gd - pd))/2 AS scale, abs(degrees(atan(gb) - atan(pb))) AS shear_deg FROM affine_pairs)"""


@query("affine_pairs", f"WITH {AFF} SELECT pair_id, regime, round(shift_px, 5) AS shift_px, round(turn_deg, 5) AS turn_deg, round(scale, 5) AS scale, round(shear_deg, 5) AS shear_deg, round(corner_px, 5) AS corner_px, round(idle_px, 5) AS idle_px FROM o JOIN e USING (pair_id)")
def affine_errors(v: Views):
    return rounded(ev.affine_errors(v.affine_pairs), n=5)


@query("affine_pairs", f"WITH {AFF}, s AS (SELECT regime, count(*) AS n, avg(corner_px) AS error, avg(idle_px) AS idle, max(CASE WHEN corner_px < 0.4*idle_px THEN idle_px END) AS largest FROM o JOIN e USING (pair_id) GROUP BY regime) SELECT regime, n, round(error, 5) AS error, round(idle, 5) AS idle, round(largest, 5) AS largest, round(1 - error/idle, 5) AS closed, CASE WHEN error < 0.4*idle THEN 'recovered' WHEN 1 - error/idle > 0.3 THEN 'partial' ELSE 'not recovered' END AS verdict FROM s")
def recoverability(v: Views):
    return rounded(ev.recoverability(ev.affine_errors(v.affine_pairs)), n=5)


# --- reports ---------------------------------------------------------------------------------------------------


@query("pixels", f"WITH {TILE} SELECT dca, count(*) AS n, round(avg(iou), 6) AS iou, round(avg(prior_iou), 6) AS prior_iou, round(any_value(o1), 6) AS iou_overall, round(any_value(o2), 6) AS prior_iou_overall, round(any_value(m1), 6) AS iou_median, round(any_value(m2), 6) AS prior_iou_median FROM tm, (SELECT avg(iou) AS o1, avg(prior_iou) AS o2, median(iou) AS m1, median(prior_iou) AS m2 FROM tm) GROUP BY dca")
def slice_report(v: Views):
    return rounded(report.slice_report(_tiles(v), "dca", ["iou", "prior_iou"]))


@query("runs", "SELECT train_ver, n_damage, grouped_cv, count(*) AS n, round(avg(iou), 6) AS mean, round(stddev_samp(iou), 6) AS sd, min(iou) AS low, max(iou) AS high, round(2*stddev_samp(iou), 6) AS believable FROM runs WHERE iou IS NOT NULL GROUP BY 1, 2, 3")
def run_stability(v: Views):
    return rounded(report.run_stability(v.runs, ["train_ver", "n_damage", "grouped_cv"]))


@query("runs", "WITH g AS (SELECT train_ver, count(*) AS n, avg(iou) AS mean, stddev_samp(iou) AS sd FROM runs WHERE iou IS NOT NULL GROUP BY 1), c AS (SELECT mean AS m FROM g WHERE train_ver = 'v5') SELECT train_ver, n, round(mean, 6) AS mean, round(m - mean, 6) AS diff, abs(m - mean) > 2*sd AS beyond FROM g, c WHERE train_ver <> 'v5' AND n >= 2")
def version_comparison(v: Views):
    return rounded(report.version_comparison(v.runs, "v5"))


@query("runs", "SELECT n_damage, round(avg(iou), 6) AS mean, count(iou) AS n FROM runs GROUP BY 1")
def learning_curve(v: Views):
    return rounded(report.learning_curve(v.runs))


HEADLINE = f"""{TILE}, {counts('prob > 0.3', into='zc')}, {counts('prob > 0.6', into='xc')}, zi AS (SELECT tile_id, {IOU} AS zero_iou FROM zc), xi AS (SELECT tile_id, {IOU} AS fixed_iou FROM xc),
pn AS (SELECT tile_id, count(*) FILTER (prob > 0.5 AND (gt OR NOT ign)) / count(*) FILTER (gt OR NOT ign) AS painted FROM pixels GROUP BY 1 HAVING NOT bool_or(gt)),
al AS (SELECT *, tile_id % 5 AS fold FROM tm JOIN zi USING (tile_id) JOIN xi USING (tile_id) LEFT JOIN pn USING (tile_id)),
fm AS (SELECT fold, avg(iou) AS m FROM al GROUP BY 1 HAVING avg(iou) IS NOT NULL), fo AS (SELECT list(round(m, 3) ORDER BY fold) AS folds, max(m) - min(m) AS fold_range FROM fm),
su AS (SELECT count(*) AS tiles, avg(iou) AS iou, avg(prior_iou) AS prior_iou, avg(zero_iou) AS zero_iou, avg(recall) AS recall, count(*) FILTER (silent) AS silent, stddev_samp(iou) AS sd, avg(painted) AS commission, count(painted) AS healthy, avg(fixed_iou - iou) AS ab_delta FROM al)"""


@query("pixels", f"WITH {HEADLINE} SELECT tiles, {', '.join(f'round({c}, 6) AS {c}' for c in ('iou', 'prior_iou', 'zero_iou', 'recall', 'sd', 'commission', 'ab_delta', 'fold_range'))}, silent, healthy, round(iou - prior_iou, 6) AS gain, round(iou - zero_iou, 6) AS zero_gain, len(folds) AS n_folds, list_min(folds) AS worst_fold, list_max(folds) AS best_fold, CASE WHEN iou - prior_iou > 0.03 THEN 'reads damage from the imagery' ELSE 'mostly echoes the prior' END AS verdict, CASE WHEN commission < 0.05 THEN 'quiet on healthy forest' WHEN commission IS NOT NULL THEN 'paints healthy forest' END AS commission_verdict, recall > 0.5 AS recall_ok FROM su, fo")
def headline_report(v: Views):
    px, valid = v.pixels, F.expr("gt or not ign")
    iou = lambda pred, name: ev.iou_dice(px, pred).select("tile_id", F.col("iou").alias(name))
    painted = px.groupBy("tile_id").agg((F.count_if(F.expr(HOT) & valid) / F.count_if(valid)).alias("painted"), F.bool_or("gt").alias("__gt")).where("not __gt").drop("__gt")
    scores = _tiles(v).join(iou("prob > 0.3", "zero_iou"), "tile_id").join(iou("prob > 0.6", "fixed_iou"), "tile_id").join(painted, "tile_id", "left")
    out = report.headline_report(scores.withColumn("fold", F.col("tile_id") % 5))
    return rounded(out.withColumns({"n_folds": F.size("folds").cast("long"), "worst_fold": F.array_min("folds"), "best_fold": F.array_max("folds")}).drop("folds"))
