"""Operators on small hand-made tables with answers worked out here."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from standmap.functions import geometry as geo
from standmap.functions import tails
from standmap.operators import annotate, evaluate, raster, select, spatial, splits
from standmap.sources import io


def pixels(spark, tiles, names=("m",)):
    """Pixel table of tiles {id: rows of characters}: '#' sets the first flag."""
    rows = [(t, y, x, c == "#") for t, lines in tiles.items() for y, line in enumerate(lines) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, f"tile_id long, y int, x int, {names[0]} boolean")


def drawn(df, flag, t=1):
    rows = df.where(F.col("tile_id") == t).collect()
    h, w = max(r.y for r in rows) + 1, max(r.x for r in rows) + 1
    at = {(r.y, r.x): r[flag] for r in rows}
    return ["".join("#" if at[y, x] else "." for x in range(w)) for y in range(h)]


def test_rasterize_honours_holes_unless_told_otherwise(spark):
    ring = [(0, 0, 0, 0), (0, 1, 6, 0), (0, 2, 6, 6), (0, 3, 0, 6), (1, 0, 2, 2), (1, 1, 2, 4), (1, 2, 4, 4), (1, 3, 4, 2)]
    v = spark.createDataFrame([(1, r, k, float(x), float(y)) for r, k, x, y in ring], "tile_id long, ring int, k int, x double, y double")
    assert raster.rasterize(v, 8, 8).count() == 32 and raster.rasterize(v, 8, 8, exterior_only=True).count() == 36
    assert raster.rasterize(v, 4, 4).count() == 16 - 4


def test_morphology(spark):
    px = pixels(spark, {1: [".....", ".###.", ".###.", ".####", "....."]})
    assert drawn(raster.morphology(px, "m", "erode"), "m") == [".....", ".....", "..#..", ".....", "....."]
    assert drawn(raster.morphology(px, "m", "open"), "m") == [".....", "..#..", ".###.", "..#..", "....."]
    opened = raster.morphology(px, "m", "open", "square")
    assert drawn(opened, "m") == [".....", ".###.", ".###.", ".###.", "....."]
    assert drawn(raster.morphology(opened, "m", "open", "square"), "m") == drawn(opened, "m")
    full = pixels(spark, {1: ["###", "###", "###"]})
    assert drawn(raster.morphology(full, "m", "erode"), "m") == ["...", ".#.", "..."]  # outside is false
    assert drawn(raster.mask_contour(full, "m"), "contour") == ["###", "#.#", "###"]


def test_components_by_connectivity(spark):
    px = pixels(spark, {1: ["##...", "..#..", "#.#.#", "###.#"], 2: [".....", ".....", "....#", "....."]})
    four = {(r.blob, r.blob_px) for r in raster.connected_components(px, "m").where("tile_id = 1").collect()}
    assert sorted(n for _, n in four) == [2, 2, 6]
    eight = {(r.blob, r.blob_px) for r in raster.connected_components(px, "m", 8).where("tile_id = 1").collect()}
    assert sorted(n for _, n in eight) == [2, 8]
    assert drawn(raster.drop_small_blobs(px, "m", 0.2), "m") == [".....", "..#..", "#.#..", "###.."]


def test_distance_transform_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    on = rng.random((16, 16)) < 0.04
    px = spark.createDataFrame([(1, y, x, bool(on[y, x])) for y in range(16) for x in range(16)] + [(2, 0, 0, False)], "tile_id long, y int, x int, m boolean")
    at = np.argwhere(on)
    for r in raster.distance_transform(px, "m").collect():
        assert r.dist is None if r.tile_id == 2 else math.isclose(r.dist, math.sqrt(((at - (r.y, r.x)) ** 2).sum(1).min()), abs_tol=1e-9)


def test_polygons_trace_blobs(spark):
    px = pixels(spark, {1: ["....", ".##.", ".#..", "...."]})
    r = raster.mask_to_polygons(px, "m").collect()[0]
    assert r.blob_px == 3 and {tuple(p) for p in r.points} == {(1, 1), (3, 1), (3, 2), (2, 2), (2, 3), (1, 3)}


def test_gaussian_and_box_reflect_at_edges(spark):
    rng = np.random.default_rng(1)
    a = rng.random((16, 16))
    px = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(16) for x in range(16)], "tile_id long, y int, x int, v double")
    pad = np.pad(a, 2, mode="symmetric")
    want = np.array([[pad[y : y + 5, x : x + 5].mean() for x in range(16)] for y in range(16)])
    std = np.array([[pad[y : y + 5, x : x + 5].std() for x in range(16)] for y in range(16)])
    for r in raster.box_stats(px, "v", 5).collect():
        assert math.isclose(r.box_mean, want[r.y, r.x], abs_tol=1e-9) and math.isclose(r.box_std, std[r.y, r.x], abs_tol=1e-7)
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    w /= w.sum()
    big = np.pad(a, 4, mode="symmetric")
    want = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 0, np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 1, big))
    for r in raster.gaussian_blur(px, "v", 1.0).collect():
        assert math.isclose(r.blur, want[r.y, r.x], abs_tol=1e-9)


def test_crop_grid_covers_far_edges_and_ids_do_not_collide(spark):
    t = spark.createDataFrame([(7, "damage", 1500.0, 5000)], "tile_id long, role string, window_m double, size_px int")
    g = raster.crop_grid(t).collect()
    assert max(r.crop_row for r in g) == 12 and len({r.crop_id for r in g}) == len(g) == 169
    assert max(r.y0 + r.full_px for r in g) == 5000


def score_table(spark):
    rows = []
    for t, gt, pred, ign in ((1, "##..", "#.#.", "...."), (2, "....", "....", "...."), (3, "##..", "....", "...."), (4, "....", "##..", "#..."), (5, "#...", "#...", "#...")):
        rows += [(t, 0, x, g == "#", p == "#", i == "#") for x, (g, p, i) in enumerate(zip(gt, pred, ign, strict=True))]
    return spark.createDataFrame(rows, "tile_id long, y int, x int, gt boolean, pred boolean, ign boolean")


def test_scores_of_empty_and_silent_tiles(spark):
    px = score_table(spark)
    by = lambda e: {r.tile_id: r.iou for r in evaluate.iou_dice(px, "pred", empty=e).collect()}
    assert by("null") == {1: 1 / 3, 2: None, 3: 0.0, 4: None, 5: 1.0}  # damage beats ignore on tile 5
    assert by("zero")[2] == 0.0 and by("one")[2] == 1.0 and by("one")[4] == 0.0
    rp = {r.tile_id: r for r in evaluate.recall_precision(px, "pred").collect()}
    assert set(rp) == {1, 3, 5} and rp[3].silent and rp[3].precision is None and rp[3].recall == 0
    c = evaluate.commission(px, "pred", "gt").first()
    assert c.tiles == 2 and c.worst == 1 / 3


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0), (None, 9.0)], "a double, b double")
    r = evaluate.spearman(df, "a", "b").first()
    assert r.n == 5 and math.isclose(r.rho, 0.8) and math.isclose(r.p, 0.1041, abs_tol=2e-4)
    m = evaluate.mann_whitney(spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, False)], "v double, g boolean"), "v", "g").first()
    assert m.u == 0 and math.isclose(m.p, 0.2453, abs_tol=1e-3)
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "s double, l boolean")
    d = evaluate.detection_auc(s, "s", "l").first()
    assert d.roc_auc == 0.875 and math.isclose(d.average_precision, (1 + 2 / 3) / 2)


def test_tails(spark):
    r = spark.range(1).select(tails.normal_two_sided(F.lit(1.96)).alias("z"), tails.student_two_sided(F.lit(2.0), F.lit(10.0)).alias("t")).first()
    assert math.isclose(r.z, 0.0499958, abs_tol=1e-6) and math.isclose(r.t, 0.0733880, abs_tol=1e-5)


def test_affine_errors_conventions(spark):
    one = {"a": 1.0, "b": 0.0, "tx": 0.0, "c": 0.0, "d": 1.0, "ty": 0.0}
    turn = math.radians(5)
    cases = {1: one, 2: one | {"tx": 30 / 192}, 3: one | {"a": math.cos(turn), "b": -math.sin(turn), "c": math.sin(turn), "d": math.cos(turn)}}
    rows = [(k, 0, *(m[x] for x in ("a", "b", "tx", "c", "d", "ty")), *(one[x] for x in ("a", "b", "tx", "c", "d", "ty"))) for k, m in cases.items()]
    names = ["pair_id", "regime", *(p + x for p in "gp" for x in ("a", "b", "tx", "c", "d", "ty"))]
    got = {r.pair_id: r for r in evaluate.affine_errors(spark.createDataFrame(rows, names)).collect()}
    assert got[1].corner_px == 0 and math.isclose(got[2].shift_px, 15) and math.isclose(got[3].turn_deg, 5)


def test_spaced_sample_equals_the_loop(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((150, 2)) * 1000)]
    kept: list = []
    for p in pts:
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 >= 80 * 80 for q in kept):
            kept.append(p)
    got = spatial.spaced_sample(spark.createDataFrame(pts, "cand_id long, cx double, cy double"), 80)
    assert {r.cand_id for r in got.collect()} == {p[0] for p in kept}
    assert [r.cand_id for r in spatial.spaced_sample(spark.createDataFrame(pts, "cand_id long, cx double, cy double"), 80, n=5).collect()] == [p[0] for p in kept[:5]]


def test_a_chain_of_candidates_takes_few_rounds(spark, caplog):
    """2,000 candidates along a line, each close to the next, in order: every third stays, in as many rounds as the line has blocks."""
    n, d = 2000, 100.0
    line = spark.createDataFrame([(i, 40.0 * i, 7.0) for i in range(n)], "cand_id long, cx double, cy double")
    with caplog.at_level("INFO", "standmap"):
        got = sorted(r.cand_id for r in spatial.spaced_sample(line, d).collect())
    assert got == list(range(0, n, 3))
    rounds = [r.args[0] for r in caplog.records if "rounds" in r.getMessage()]
    assert rounds and rounds[0] <= 40.0 * n / (spatial.BLOCK * d) + 2
    assert spatial.spaced_sample(line.limit(0), d).count() == 0


def test_within_region_and_holes(spark):
    ring = lambda i, kind, pts: [(i, kind, k, float(x), float(y)) for k, (x, y) in enumerate(pts)]
    regions = spark.createDataFrame(ring(1, "surveyed", [(0, 0), (100, 0), (100, 100), (0, 100)]) + ring(2, "not_flown", [(40, 40), (60, 40), (60, 60), (40, 60)]), "region_id long, kind string, k long, x double, y double")
    cand = spark.createDataFrame([(1, 20.0, 20.0), (2, 50.0, 50.0), (3, 36.0, 50.0), (4, 98.0, 50.0), (5, 150.0, 50.0), (6, 50.0, 30.0)], "cand_id long, cx double, cy double")
    assert {r.cand_id for r in spatial.within_region(cand, 5, regions, cell=30).collect()} == {1, 6}


def test_boxes_across_touching_and_overlapping_rings_lie_in_the_union(spark):
    ring = lambda i, pts: [(i, "surveyed", k, float(x), float(y)) for k, (x, y) in enumerate(pts)]
    rows = ring(1, [(0, 0), (50, 0), (50, 100), (0, 100)]) + ring(2, [(50, 20), (100, 20), (100, 80), (50, 80)]) + ring(3, [(90, 30), (150, 30), (150, 70), (90, 70)])
    regions = spark.createDataFrame(rows, "region_id long, kind string, k long, x double, y double")
    cand = spark.createDataFrame([(1, 50.0, 50.0), (2, 50.0, 18.0), (3, 95.0, 50.0), (4, 95.0, 72.0), (5, 100.0, 50.0), (6, 52.0, 86.0), (7, 148.0, 50.0)], "cand_id long, cx double, cy double")
    assert {r.cand_id for r in spatial.within_region(cand, 5, regions, cell=30).collect()} == {1, 3, 4, 5} - {4}


def test_features_are_polygons_not_boxes(spark):
    """A box beside a triangle's slope, one across it, one inside a large ring, and one around a point."""
    v = [(1, k, x, y) for k, (x, y) in enumerate(((0.0, 0.0), (100.0, 0.0), (0.0, 100.0)))] + [(2, k, x, y) for k, (x, y) in enumerate(((200.0, 0.0), (300.0, 0.0), (300.0, 100.0), (200.0, 100.0)))] + [(3, 0, 400.0, 50.0)]
    cand = spark.createDataFrame([(1, 80.0, 80.0), (2, 50.0, 50.0), (3, 250.0, 50.0), (4, 398.0, 52.0), (5, 180.0, 50.0)], "cand_id long, cx double, cy double")
    got = spatial.clear_of_features(cand, 5, spark.createDataFrame(v, "poly_id long, k long, x double, y double"), 2, cell=40)
    assert {r.cand_id for r in got.collect()} == {1, 5}


def test_overlap_of_moved_polygons(spark):
    square = lambda i, x, y, s: [(i, k, x + s * a, y + s * b) for k, (a, b) in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)))]
    a = spark.createDataFrame(square(1, 0, 0, 10), "poly_id long, k long, x double, y double")
    b = spark.createDataFrame(square(1, 5, 0, 10), "poly_id long, k long, x double, y double")
    r = spatial.polygon_overlap(a, b).first()
    assert abs(r.iou_raw - 1 / 3) < 1e-12 and abs(r.iou_shift - 1) < 1e-12 and r.shift_m == 5 and r.area_ratio == 1
    # centroids, not means of vertices: one more vertex on a side moves nothing
    more = spark.createDataFrame([*square(1, 0, 0, 10), (1, 9, 0.0, 5.0)], "poly_id long, k long, x double, y double")
    r = spatial.polygon_overlap(a, more).first()
    assert abs(r.shift_m) < 1e-9 and abs(r.iou_shift - 1) < 1e-9
    # a diamond of area 50 whose corners touch the square's sides, far from the origin, one of them the other way round
    far = 1e6
    diamond = [(1, k, far + x, far + y) for k, (x, y) in enumerate(((5.0, 0.0), (0.0, 5.0), (5.0, 10.0), (10.0, 5.0)))]
    star = [(1, k, far + x, far + y) for k, (x, y) in enumerate(((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)))]  # area 60
    table = lambda rows: spark.createDataFrame(rows, "poly_id long, k long, x double, y double")
    r = spatial.polygon_overlap(table(square(1, far, far, 10)), table(diamond)).first()
    assert abs(r.iou_raw - 0.5) < 1e-9 and abs(r.iou_scaled - shared_square_diamond()) < 1e-9 and r.area_ratio == 0.5
    r = spatial.polygon_overlap(table(square(1, far, far, 5)), table(star)).first()
    assert abs(r.iou_raw - 22.1875 / (25 + 60 - 22.1875)) < 1e-9  # the notch takes 3 * 1.875 / 2 from the square's upper right
    assert spatial.polygon_overlap(table(square(1, 0, 0, 1)), table(square(1, 5, 5, 1))).first().iou_raw == 0


def shared_square_diamond():
    """A square of area 100 and a diamond of the same: the diamond's corners stand out by r - 5 each."""
    r = math.sqrt(50)
    shared = 100 - 4 * (r - 5) ** 2
    return shared / (200 - shared)


def test_checkpoints_resume_after_a_crash(spark, tmp_path, monkeypatch):
    """A run that dies while it stores a fold leaves that one to do, also where an older one stood there before."""
    path, every = str(tmp_path / "cache"), spark.createDataFrame([(0,), (1,), (2,)], "fold long")
    px = lambda f, p: spark.createDataFrame([(10 * f + t, f, 0, x, p) for t in range(2) for x in range(3)], "tile_id long, fold long, y int, x int, prob double")
    scores = lambda f, s: spark.createDataFrame([(10 * f + t, f, s, 0.4) for t in range(2)], "tile_id long, fold long, iou double, threshold double")
    todo = lambda: sorted(r.fold for r in io.unfinished_folds(every, path).collect())
    with pytest.raises(FileNotFoundError):
        io.read_checkpoint(spark, path)
    assert todo() == [0, 1, 2]
    io.prediction_checkpoint(px(0, 1.7), scores(0, 0.1), path)
    io.prediction_checkpoint(px(1, -0.2), scores(1, 0.2), path)
    assert todo() == [2]
    writes = []

    def dying(self, *a, **k):
        writes.append(a[0])
        if "scores" in a[0]:
            raise KeyboardInterrupt
        return real(self, *a, **k)

    from pyspark.sql import DataFrameWriter

    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    for fold in (1, 2):
        with pytest.raises(KeyboardInterrupt):
            io.prediction_checkpoint(px(fold, 0.5), scores(fold, 0.9), path)
    monkeypatch.undo()
    assert len(writes) == 4 and todo() == [1, 2]
    pixels, kept = io.read_checkpoint(spark, path)
    assert {(r.fold, r.q) for r in pixels.collect()} == {(0, 255)} and {(r.fold, r.iou, r.threshold) for r in kept.collect()} == {(0, 0.1, 0.4)}
    for fold in todo():
        io.prediction_checkpoint(px(fold, 0.5), scores(fold, 0.9), path)
    pixels, kept = io.read_checkpoint(spark, path)
    assert todo() == [] and sorted((r.fold, r.q) for r in pixels.collect()) == [(0, 255)] * 6 + [(1, 127)] * 6 + [(2, 127)] * 6
    assert {(r.fold, r.iou) for r in kept.collect()} == {(0, 0.1), (1, 0.9), (2, 0.9)}


def test_headline_by_hand(spark):
    from standmap.operators import report

    rows = [(1, 0, 0.30, 0.20, 0.10, 0.25, 0.6, False, None), (2, 0, 0.10, 0.20, 0.10, 0.15, 0.2, False, None), (3, 1, 0.35, 0.20, 0.05, 0.35, 1.0, False, None), (4, 1, None, None, None, None, None, True, 0.0), (5, 2, None, None, None, None, None, False, 0.08)]
    names = "tile_id long, fold long, iou double, prior_iou double, zero_iou double, fixed_iou double, recall double, silent boolean, painted double"
    r = report.headline_report(spark.createDataFrame(rows, names)).first()
    assert (r.tiles, r.silent, r.healthy, r.folds) == (5, 1, 2, [0.2, 0.35]) and math.isclose(r.iou, 0.25) and math.isclose(r.gain, 0.05) and math.isclose(r.zero_gain, 1 / 6)
    assert math.isclose(r.commission, 0.04) and abs(r.ab_delta) < 1e-12 and math.isclose(r.fold_range, 0.15) and r.recall_ok
    assert (r.verdict, r.commission_verdict) == ("reads damage from the imagery", "quiet on healthy forest")
    r = report.headline_report(spark.createDataFrame([(1, 0, 0.22, 0.20, 0.1, 0.2, 0.5, False, None), (2, 0, None, None, None, None, None, False, 0.05)], names)).first()
    assert (r.verdict, r.commission_verdict, r.recall_ok) == ("mostly echoes the prior", "paints healthy forest", False)


def test_interleaving_is_a_permutation_in_rounds(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "b"), (6, "a")], "poly_id long, dca string")
    out = [(r.turn, r.poly_id) for r in select.interleave_groups(df, "dca", [F.col("poly_id")]).collect()]
    assert out == [(1, 1), (1, 3), (1, 4), (2, 2), (2, 5), (3, 6)]
    assert select.interleave_groups(df, "dca", [F.col("poly_id")], drop_null_groups=True).count() == 5


def test_rounding_is_half_to_even_and_large_windows_are_null(spark):
    df = spark.createDataFrame([(1, 0.75 / 1.5), (2, 1200.0)], "poly_id long, extent_m double")
    got = geo.window_and_size(df, gsd=0.3, min_m=0, px=(1, 9999)).collect()
    assert got[0].size_px == 2 and got[1].window_m is None and got[1].size_px is None


def test_projection_returns_and_units_scale(spark):
    df = spark.createDataFrame([(-120.5, 43.0), (-124.0, 42.0)], "lon double, lat double")
    out = geo.reproject(df, "lambert")
    back = geo.reproject(out.drop("lon", "lat"), "wgs84").collect()
    assert all(abs(r.lon - o[0]) < 1e-9 and abs(r.lat - o[1]) < 1e-9 for r, o in zip(back, ((-120.5, 43.0), (-124.0, 42.0)), strict=True))
    feet = geo.reproject(df, "lambert", geo.Lambert(unit_m=0.3048)).collect()
    assert all(math.isclose(f.x * 0.3048, m.x, rel_tol=1e-12) for f, m in zip(feet, out.collect(), strict=True))


def test_labels_and_shapes(spark):
    rows = [(1, " Prior", "polygon", "[[0,0],[1,1]]"), (2, "unsure", "rectangle", "[[0,0],[2,3]]"), (3, "x", "circle", "[[0,0],[2,0]]"), (4, None, "line", "[[0,0],[2,0]]")]
    got = {r.ann_id: r for r in annotate.shape_table(spark.createDataFrame(rows, "ann_id long, label string, shape_type string, points_json string")).collect()}
    assert got[1].kind == "guide" and got[1].ring is None and got[2].ring == [[0, 0], [2, 0], [2, 3], [0, 3]] and len(got[3].ring) == 48 and got[4].ring is None


def test_damage_beats_ignore_in_masks(spark):
    rows = [(1, 1, "damage", [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]), (1, 2, "ignore", [[1.0, 0.0], [3.0, 0.0], [3.0, 2.0], [1.0, 2.0]])]
    m = raster.shapes_to_masks(spark.createDataFrame(rows, "tile_id long, shape_id long, kind string, ring array<array<double>>"), 4, 4).collect()
    assert sum(r.damage for r in m) == 4 and sum(r.ignore for r in m) == 2


def test_folds_never_split_a_source(spark):
    t = spark.createDataFrame([(i, i // 3, float(i % 7) if i < 27 else None, float(i % 5)) for i in range(33)], "tile_id long, source_id long, lon double, lat double")
    f = splits.spatial_folds(t, "source_id", 3)
    assert f.count() == 33 and splits.leakage_check(f, "source_id").count() == 0
    h = splits.group_holdout(t, "source_id")
    assert h.where("part = 'val'").select("source_id").distinct().count() == 2
    r = splits.random_folds(t, 4, 1).groupBy("fold").count().collect()
    assert sorted(x["count"] for x in r) == [8, 8, 8, 9]


def test_fold_sizes_and_the_fallback(spark):
    rows = [(i, i // 2, float(i // 2 % 7), float(i // 14)) for i in range(40)] + [(100, 90, None, None)]
    t = spark.createDataFrame(rows, "tile_id long, source_id long, lon double, lat double")
    folds = splits.spatial_folds(t, "source_id", 3)
    r = splits.fold_sizes(folds).collect()
    assert sum(x.tiles for x in r) == 41 and {x.spatial for x in r} == {True} and len({x.uneven for x in r}) == 1
    few = splits.spatial_folds(t.where("source_id in (0, 1, 90)"), "source_id", 3)
    assert {x.spatial for x in few.collect()} == {False} and few.groupBy("source_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    lop = spark.createDataFrame([(i, min(i // 5, 1), True) for i in range(25)], "tile_id long, fold int, spatial boolean")
    assert {(x.fold, x.tiles, x.uneven) for x in splits.fold_sizes(lop).collect()} == {(0, 5, True), (1, 20, True)}


def test_presence_guard_fails_on_many_missing(spark):
    m = spark.createDataFrame([(i,) for i in range(10)], "tile_id long")
    assert io.presence_guard(m, m).first().missing == 0
    with pytest.raises(ValueError):
        io.presence_guard(m, m.where("tile_id > 0"))


def test_append_index_continues_ids_and_fills_columns(spark):
    prev = spark.createDataFrame([(7, "damage")], "tile_id long, role string")
    new = spark.createDataFrame([(0, 2.0, "b"), (0, 1.0, "a")], "tile_id long, lat double, name string")
    got = {r.tile_id: (r.role, r.name) for r in io.append_index(prev, new, ["lat"]).collect()}
    assert got == {7: ("damage", None), 8: (None, "a"), 9: (None, "b")}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("l", 1), ("l", 2), ("m", 1)], "layer string, v long")
    digest = lambda d: {tuple(r) for r in io.dataset_fingerprint(d, "layer", ["v"]).collect()}
    assert digest(a) == digest(a.orderBy(F.desc("v")).repartition(3))
    assert digest(a) != digest(a.withColumn("v", F.col("v") + 1))


def png(path, rows):
    """An 8-bit PNG of rows of ints (grey) or of 3-tuples."""
    colour = 2 if isinstance(rows[0][0], tuple) else 0
    raw = b"".join(b"\0" + bytes(v for p in r for v in (p if colour else (p,))) for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_raster_layers_from_png(spark, tmp_path):
    png(tmp_path / "images/0007.png", [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (10, 11, 12)]])
    png(tmp_path / "masks/0007.png", [[255, 128], [0, 129]])
    got = {(r.y, r.x): (r.tile_id, r.r, r.g, r.b, r.gt) for r in io.read_raster_layers(spark, str(tmp_path), ("images", "masks")).collect()}
    assert got == {(0, 0): ("0007", 1, 2, 3, True), (0, 1): ("0007", 4, 5, 6, False), (1, 0): ("0007", 7, 8, 9, False), (1, 1): ("0007", 10, 11, 12, True)}


def test_layers_written_are_layers_read(spark, tmp_path):
    """Tiles of several shapes, one without near infrared, and a layer that isn't written."""
    rows = [(t, y, x, (7 * x + len(t)) % 256, (31 * y) % 256, 255, x > y, y == 0, False, None if t == "0002" else x + y) for t, h, w in (("0001", 5, 9), ("0002", 1, 3), ("a b", 16, 16)) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "tile_id string, y int, x int, r int, g int, b int, gt boolean, prior boolean, ign boolean, nir int")
    root = str(tmp_path / "layers")
    made = io.write_raster_layers(px.repartition(3), root)
    assert {(r.tile_id, r.layer) for r in made.collect()} == {(t, n) for t in ("0001", "0002", "a b") for n in ("images", "masks", "priors", "ignore", "nir")} - {("0002", "nir")}
    back = io.read_raster_layers(spark, root).select(px.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    io.write_raster_layers(px.where("tile_id = '0001'"), str(tmp_path / "one"), ["images", "masks"])
    assert io.read_raster_layers(spark, str(tmp_path / "one"), ["images", "masks"]).where("gt").count() == sum(r[6] for r in rows if r[0] == "0001")


def test_selected_epoch_needs_a_margin(spark):
    log = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (0, 3, 0.503), (0, 4, 0.51)], "fold int, epoch long, inner_iou double")
    assert evaluate.select_epoch(log, 0.5).first().epoch == 4
    assert evaluate.select_epoch(log.where("epoch < 4"), 0.5).first().epoch == 2


def test_plans_of_spatial_joins_have_no_nested_loops(spark):
    cand = spark.range(10).selectExpr("id as cand_id", "cast(id as double) cx", "cast(id as double) cy")
    feat = spark.range(10).selectExpr("id as poly_id", "0 as k", "cast(id as double) x", "cast(id as double) y")
    for df in (spatial.clear_of_features(cand, 5, feat), spatial.min_spacing_to(cand, cand.selectExpr("cx as x", "cy as y"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shares_are_taken_without_one_task(spark):
    """Samples whose size is a share of the table equal a sort and a cut, and no limit merges them in one task."""
    rows = [(i, i % 50, "damage" if i % 4 == 0 else "negative", i % 4 == 0) for i in range(400)]
    t = spark.createDataFrame(rows, "tile_id long, source_id long, role string, pos boolean")
    key = lambda i: ((i * 7919 + 42 * 104729) % 1000003, i)
    negatives = sorted((i for i in range(400) if i % 4), key=key)
    capped = select.capped_negatives(t, 0.25, 42, "tile_id")
    sample = select.ratio_sample(t, "pos", 0.25)
    held = splits.group_holdout(t, "source_id")
    first = [i for n, i in enumerate(negatives) if i % 50 not in {j % 50 for j in negatives[:n]}]  # one of each source
    assert [r.tile_id for r in capped.collect()] == first[:25]
    assert {r.tile_id for r in sample.where("not pos").collect()} == set(negatives[:25]) and sample.where("pos").count() == 100
    assert {r.source_id for r in held.where("part = 'val'").collect()} == set(sorted(range(50), key=key)[:8])
    for df in (capped, sample, held):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit" not in plan and "LocalLimit" not in plan


SIZES = {1: (24, 20), 2: (40, 40), 3: (5, 33)}


def sized(spark, seed=0):
    """Pixels of tiles of several sizes, and their rasters."""
    rng = np.random.default_rng(seed)
    v = {t: rng.random(s) for t, s in SIZES.items()}
    m = {t: rng.random(s) < 0.3 for t, s in SIZES.items()}
    rows = [(t, y, x, float(v[t][y, x]), bool(m[t][y, x]), int(255 * v[t][y, x]), int(255 * v[t][y, x] ** 2), 90, 120) for t, (h, w) in SIZES.items() for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "tile_id long, y int, x int, v double, m boolean, r int, g int, b int, nir int"), v, m


def as_rasters(df, col):
    out = {t: np.full(s, np.nan) for t, s in SIZES.items()}
    for r in df.select("tile_id", "y", "x", col).collect():
        assert np.isnan(out[r.tile_id][r.y, r.x])
        out[r.tile_id][r.y, r.x] = float(r[col])
    assert not any(np.isnan(a).any() for a in out.values())
    return out


def test_windows_take_each_tiles_own_size(spark):
    px, v, m = sized(spark)
    pad = lambda a, k: np.pad(a, ((k // 2, k - 1 - k // 2),) * 2, mode="symmetric")
    box = lambda a, k: np.array([[pad(a, k)[y : y + k, x : x + k].mean() for x in range(a.shape[1])] for y in range(a.shape[0])])
    got = as_rasters(raster.box_stats(px, "v", 9), "box_mean")
    assert all(np.allclose(got[t], box(v[t], 9)) for t in SIZES)
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    w /= w.sum()
    smooth = lambda a: np.apply_along_axis(lambda c: np.convolve(np.pad(c, 8, mode="symmetric"), w, "valid"), 0, np.apply_along_axis(lambda c: np.convolve(np.pad(c, 8, mode="symmetric"), w, "valid"), 1, a))
    got = as_rasters(raster.gaussian_blur(px, "v", 2.0), "blur")
    assert all(np.allclose(got[t], smooth(v[t])) for t in SIZES)
    for op, grow in (("dilate", True), ("erode", False)):
        for k in (3, 4, 7):
            wide = lambda a, k=k: np.pad(a, ((k // 2, k - 1 - k // 2),) * 2)
            want = {t: np.array([[(np.any if grow else np.all)(wide(m[t])[y : y + k, x : x + k]) for x in range(s[1])] for y in range(s[0])]) for t, s in SIZES.items()}
            got = as_rasters(raster.morphology(px, "m", op, "square", k=k), "m")
            assert all((got[t] == want[t]).all() for t in SIZES)
    got = raster.shift_mask(px, "m", 6, -3).collect()
    assert {(r.tile_id, r.y, r.x) for r in got} == {(t, y - 3, x + 6) for t, (h, w_) in SIZES.items() for y, x in np.argwhere(m[t]).tolist() if y >= 3 and x + 6 < w_}
    for name in ("stress", "damage_map"):
        assert as_rasters(raster.gap_and_damage_map(px, "m"), name)[2].shape == (40, 40)
    d = as_rasters(raster.distance_transform(px, "m"), "dist")
    for t, (h, w_) in SIZES.items():
        at = np.argwhere(m[t])
        assert all(math.isclose(d[t][y, x], math.sqrt(((at - (y, x)) ** 2).sum(1).min()), abs_tol=1e-9) for y in range(h) for x in range(w_))


def test_views_of_oblong_tiles_are_undone(spark):
    px, v, _ = sized(spark)
    rows = [(t, k, f, y, x, float((np.fliplr(np.rot90(v[t], k)) if f else np.rot90(v[t], k))[y, x])) for t in SIZES for k in range(4) for f in (False, True) for y in range(np.rot90(v[t], k).shape[0]) for x in range(np.rot90(v[t], k).shape[1])]
    got = as_rasters(raster.tta_average(spark.createDataFrame(rows, "tile_id long, turns int, flip boolean, y int, x int, prob double")), "prob")
    assert all(np.allclose(got[t], v[t]) for t in SIZES)


def test_compositions_keep_every_pixel(spark):
    px, _, _ = sized(spark)
    assert as_rasters(raster.proximity_map(px, "v"), "proximity")[1].shape == (24, 20)
    out = raster.weak_label(px, "v", shift=3)
    assert as_rasters(out, "weak")[3].any() and as_rasters(out, "corrupt")[3].shape == (5, 33)
    empty = px.withColumn("m", F.lit(False))
    near = as_rasters(raster.near_prior(empty, "m", "near"), "near")
    assert all(a.all() for a in near.values())  # without a prior, everywhere
    one = as_rasters(raster.near_prior(px.withColumn("m", F.expr("y = 0 and x = 0")), "m", "near"), "near")
    assert one[2][:4, :4].sum() == one[2].sum() == 16  # 15% of 40 is 6: a pixel sees from 3 before to 2 behind it


def test_alignment_finds_a_planted_shift(spark):
    """A block of stress, and a mask of its shape at another place: the search moves the mask onto it."""
    rows = []
    for y in range(40):
        for x in range(40):
            rows.append((1, y, x, 12 <= y < 24 and 14 <= x < 30, 1.0 if 17 <= y < 29 and 8 <= x < 24 else 0.0))
            rows.append((2, y, x, y < 2 and x < 2, 0.5))
    px = raster.proximity_map(spark.createDataFrame(rows, "tile_id long, y int, x int, m boolean, stress double"), "stress", pct=0)
    got = {r.tile_id: r for r in raster.alignment_search(px, "m", "stress", radius=10, step=4, fine=4).collect()}
    assert (got[1].dx, got[1].dy) == (-6, 5) and got[1].score > 0.6
    assert (got[2].dx, got[2].dy, got[2].score) == (0, 0, 0.0)  # too small to move


def test_rules_of_scores(spark):
    """Worked by hand: paint-everything needs recall and imprecision, empty tiles pool their pixels, collapsed folds, wrapped turns."""
    rows = [(1, 0, x, x < 2, True, False) for x in range(40)] + [(2, 0, x, x < 30, True, False) for x in range(40)] + [(3, 0, x, False, x < 1, False) for x in range(2)] + [(4, 0, x, False, False, False) for x in range(38)]
    px = spark.createDataFrame(rows, "tile_id long, y int, x int, gt boolean, pred boolean, ign boolean")
    assert {r.tile_id: r.paints_all for r in evaluate.recall_precision(px, "pred").collect()} == {1: True, 2: False}
    s = evaluate.recall_precision_summary(evaluate.recall_precision(px, "pred")).first()
    assert s.recall == 1 and math.isclose(s.precision_like, (2 / 40 + 30 / 40) / 2) and s.recall_clean == 1 and s.paints_all == 1
    assert math.isclose(evaluate.macro_scores(px, "pred").first().false_positive_rate, 1 / 40)
    folds = spark.createDataFrame([(f, v) for f, v in enumerate((0.5, 0.4, 0.3, 0.15, 0.04))], "fold int, iou double")
    assert {r.fold for r in evaluate.fold_health(folds).where("collapsed").collect()} == {4}
    log = lambda n: spark.createDataFrame([(0, e + 1, 1.0 + (0.1 if e >= n - 3 else 0.0), 0.5) for e in range(n)], "fold int, epoch long, loss double, inner_iou double")
    assert evaluate.convergence_check(log(12)).first().rising is True
    short = evaluate.convergence_check(log(5)).first()
    assert short.rising is None and short.last is None
    same = spark.createDataFrame([(1.0, i % 2 == 0) for i in range(10)], "v double, g boolean").withColumn("v", F.lit(1.0))
    big = same.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300_000)))).select("v", "g")
    m = evaluate.mann_whitney(big, "v", "g").first()
    assert m.n1 == m.n2 == 1_500_000 and m.z is None
    q = spark.createDataFrame([(float(i), i / 10) for i in range(12)], "d double, iou double").withColumn("silent", F.lit(False))
    assert sorted((r.quartile, r.n, r.low, r.high) for r in evaluate.quartile_report(q, "d").collect()) == [(1, 3, 0.0, 2.75), (2, 3, 2.75, 5.5), (3, 3, 5.5, 8.25), (4, 3, 8.25, 11.0)]
    assert evaluate.quartile_report(q.withColumn("d", 100 + F.col("d") / 10), "d").count() == 0  # hardly any spread
    turned = {"pair_id": 1, "regime": 0} | {"g" + k: x for k, x in zip(("a", "b", "tx", "c", "d", "ty"), (math.cos(3.1), 0.0, 0.0, math.sin(3.1), 1.0, 0.0), strict=True)} | {"p" + k: x for k, x in zip(("a", "b", "tx", "c", "d", "ty"), (math.cos(-3.1), math.tan(0.2), 0.0, math.sin(-3.1), 1.5, 0.0), strict=True)}
    r = evaluate.affine_errors(spark.createDataFrame([tuple(turned.values())], list(turned))).first()
    assert math.isclose(r.turn_deg, math.degrees(2 * math.pi - 6.2), abs_tol=1e-6) and math.isclose(r.scale, 0.25, abs_tol=1e-9) and math.isclose(r.shear_deg, math.degrees(0.2), abs_tol=1e-9)
    e = spark.createDataFrame([(0, 1.0, 10.0), (0, 3.9, 10.0), (0, 4.0, 10.0), (1, 6.5, 10.0), (2, 8.0, 10.0)], "regime int, corner_px double, idle_px double")
    assert {r.regime: (r.verdict, r.largest) for r in evaluate.recoverability(e).collect()} == {0: ("recovered", 10.0), 1: ("partial", None), 2: ("not recovered", None)}


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.random(200), 2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = evaluate.quantiles(df, "v", (0.0, 0.25, 0.5, 0.99, 1.0)).first().q
    assert np.allclose(got, np.quantile(v, (0.0, 0.25, 0.5, 0.99, 1.0)))
    assert evaluate.quantiles(df.where("v > 2"), "v", (0.5,)).first().q == [None]


def test_manifest_rules(spark):
    """A later list wins, damage pixels beat a bucket of negatives, and untrusted negatives stay out."""
    tiles = spark.createDataFrame([(i, "negative" if i in (6, 7, 8) else "damage") for i in range(1, 13)], "tile_id long, role string")
    buckets = spark.createDataFrame([(1, "delete"), (1, "no_damage"), (2, "no_damage"), (3, "treecut_ignore"), (4, "treecut_ignore"), (5, "damage_ignore"), (9, "too_small"), (12, "no_damage")], "tile_id long, bucket string")
    masks = spark.createDataFrame([(2, 9), (3, 4), (4, 0), (8, 3), (9, 50), (10, 0)], "tile_id long, damage_px long")
    out = {r.tile_id: (r.role, r.use, r.warning) for r in annotate.build_manifest(tiles, buckets, masks, tiles.limit(0), tiles.where("tile_id = 6")).collect()}
    assert out == {
        1: ("negative", True, "several buckets; no_damage without a mask"), 2: ("damage", True, "no_damage but 9 damage px"), 3: ("damage", True, ""), 4: ("exclude", False, ""),
        5: ("damage", True, "damage_ignore without damage px"), 6: ("negative", True, ""), 7: ("exclude", False, ""), 8: ("damage", True, "negative in the index but 3 damage px"),
        9: ("exclude", False, ""), 10: ("exclude", False, "empty and unlisted"), 11: ("skip", False, ""), 12: ("negative", True, "no_damage without a mask"),
    }


def test_clean_counts_in_the_job_of_empty_tiles_alone(spark):
    ann = spark.createDataFrame([(1, "clean"), (2, "clean"), (2, "dead"), (3, "prior")], "tile_id long, label string")
    by = lambda job: {r.tile_id: r.verdict for r in annotate.tile_verdict(ann, job).collect()}
    assert by("empty") == {1: "clean", 2: "damage", 3: "untouched"} and by("negatives") == {1: "untouched", 2: "damage", 3: "untouched"}


def test_circles_are_masked_like_brute_force(spark):
    """Masks of all shapes against the even-odd rule at pixel centres."""
    rows = [(1, 1, "damage", "circle", [[5.0, 5.0], [8.3, 5.0]]), (1, 2, "ignore", "circle", [[9.1, 9.2], [9.1, 12.0]]), (1, 3, "damage", "polygon", [[1.2, 9.0], [4.0, 15.0], [0.4, 14.0]])]
    s = spark.createDataFrame(rows, "tile_id long, shape_id long, kind string, shape_type string, points array<array<double>>")
    shapes = s.withColumn("ring", annotate.shape_to_polygon(F.col("shape_type"), F.col("points")))
    rings = {r.shape_id: r.ring for r in shapes.collect()}

    def inside(ring, x, y):
        return sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > x for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) % 2 == 1

    at = {k: {(y, x) for y in range(16) for x in range(16) if inside(ring, x + 0.5, y + 0.5)} for k, ring in rings.items()}
    got = raster.shapes_to_masks(shapes, 16, 16).collect()
    assert {(r.y, r.x) for r in got if r.damage} == at[1] | at[3] and {(r.y, r.x) for r in got if r.ignore} == at[2] - at[1] - at[3]


def test_cell_index_holds_points_like_parity(spark):
    """A ring of 10,000 edges and one within it, points on whole numbers, cells of several sizes; joins are on both row and column."""
    n = 10_000
    r = np.random.default_rng(2).uniform(300, 500, n).tolist()
    a = [k * 2 * math.pi / n for k in range(n)]
    ring = [(1, "surveyed", k, round(500 + r[k] * math.cos(a[k]), 2), round(500 + r[k] * math.sin(a[k]), 2)) for k in range(n)]
    ring += [(2, "not_flown", k, x, y) for k, (x, y) in enumerate(((400.0, 400.0), (600.0, 400.0), (600.0, 600.0), (400.0, 600.0)))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(3).integers(-50, 1050, (400, 2)).tolist())]

    def parity(p, of):
        v = [(x, y) for i, _, _, x, y in ring if i == of]
        return sum(((y0 <= p[2] < y1) or (y1 <= p[2] < y0)) and x0 + (p[2] - y0) * (x1 - x0) / (y1 - y0) > p[1] for (x0, y0), (x1, y1) in zip(v, v[1:] + v[:1], strict=True)) % 2

    want = {(p[0], of) for p in pts for of in (1, 2) if parity(p, of)}
    e = spatial._edges(spark.createDataFrame(ring, "region_id long, kind string, k long, x double, y double"), ["region_id"])
    points = spark.createDataFrame(pts, "id long, px double, py double")
    for cell in (37.0, 400.0):
        held = spatial._held_by(points, spatial.cell_index(e, cell), cell, ["id"])
        assert {(r.id, r.region_id) for r in held.collect()} == want
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "row" in plan.split("Join Inner")[1].split("\n")[0] and "col" in plan.split("Join Inner")[1].split("\n")[0]


def test_crops_of_a_large_tile_hold_their_pixels(spark):
    """Each pixel of a 2,048-pixel tile's sample meets just the crops that hold it, and no window is filtered after the join."""
    tiles = spark.createDataFrame([(7, "damage", 1500.0, 2048), (8, "negative", 300.0, 700)], "tile_id long, role string, window_m double, size_px int")
    grid = raster.crop_grid(tiles, gsd=0.60, crop=384)
    rng = np.random.default_rng(4)
    at = [(7, *map(int, rng.integers(0, 2048, 2)), True) for _ in range(3000)] + [(7, y, x, True) for y in (0, 2047) for x in (0, 1000, 2047)] + [(8, *map(int, rng.integers(0, 700, 2)), True) for _ in range(300)]
    px = spark.createDataFrame(sorted(set(at)), "tile_id long, y int, x int, gt boolean")
    crops = grid.collect()
    want = sorted((c.crop_id, y - c.y0, x - c.x0) for t, y, x, _ in set(at) for c in crops if c.tile_id == t and c.y0 <= y < c.y0 + c.full_px and c.x0 <= x < c.x0 + c.full_px)
    out = raster.crop_pixels(grid, px)
    assert sorted((r.crop_id, r.y, r.x) for r in out.collect()) == want and len(want) > 5000
    counts = {r.crop_id: r.label_px for r in raster.crop_labels(grid, px, 0).collect()}
    assert counts == {c.crop_id: sum(w[0] == c.crop_id for w in want) for c in crops}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(">=" in line and "y0" in line for line in plan.split("\n"))


def test_large_rasters_go_by_strips_and_blocks(spark, monkeypatch):
    """Distances of a 3,000-pixel raster in strips, and blobs whatever the blocks, against plain loops."""
    from standmap.operators import blocks

    rng = np.random.default_rng(6)
    spots = {tuple(map(int, rng.integers(0, 3000, 2))) for _ in range(12)}
    on = spark.createDataFrame([(y, x, True) for y, x in spots], "y long, x long, m boolean")
    px = spark.range(3000).select(F.col("id").alias("y")).crossJoin(spark.range(3000).select(F.col("id").alias("x"))).join(F.broadcast(on), ["y", "x"], "left").select(F.lit(1).alias("tile_id"), F.col("y").cast("int"), F.col("x").cast("int"), "m")
    near = F.array_min(F.array(*(F.sqrt((F.col("y") - y) * (F.col("y") - y) + (F.col("x") - x) * (F.col("x") - x)) for y, x in spots)))
    assert raster.distance_transform(px, "m").agg(F.max(F.abs(F.col("dist") - near)), F.count("dist")).first()[:] == (0.0, 9_000_000)
    shape = (rng.random((70, 90)) < 0.45).tolist()
    small = pixels(spark, {1: ["".join(".#"[v] for v in row) for row in shape], 2: ["###", "..#"], 3: ["..."]})
    monkeypatch.setattr(blocks, "TOGETHER", 500)
    for connectivity in (4, 8):
        of = lambda block: sorted(map(tuple, raster.connected_components(small, "m", connectivity, block).select("tile_id", "y", "x", "blob", "blob_px").collect()))  # noqa: B023, E731
        whole = of(512)
        assert whole == of(7) == of(16) and {b for t, *_, b, _ in whole if t == 2} == {0}


def test_spirals_are_one_blob_over_blocks(spark):
    n = 25
    grid, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    for _ in range(4 * n):
        grid[y, x] = True
        if not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and grid[y + 2 * dy, x + 2 * dx]):
            dy, dx = dx, -dy
        y, x = y + dy, x + dx
    px = pixels(spark, {1: ["".join(".#"[v] for v in row) for row in grid.tolist()]})
    got = raster.connected_components(px, "m", 4, 4).collect()
    assert {r.blob for r in got} == {0} and {r.blob_px for r in got} == {len(got)} == {int(grid.sum())}


def test_outlines_walk_around_pinches_and_pass_holes(spark):
    """A ring with a hole, two pixels that meet at a point (one blob by 8), and a staircase; clockwise from the upper left."""
    px = pixels(spark, {1: ["###..", "#.#..", "###.."], 2: ["##..", "##..", "..##", "..##"], 3: ["#..", "##.", "###"]})
    got = {(r.tile_id, r.blob): r for r in raster.mask_to_polygons(px, "m", connectivity=8).collect()}
    assert got[1, 0].points == [[0, 0], [3, 0], [3, 3], [0, 3]] and got[1, 0].blob_px == 8
    assert got[2, 0].points == [[0, 0], [2, 0], [2, 2], [4, 2], [4, 4], [2, 4], [2, 2], [0, 2]]
    assert got[3, 0].points == [[0, 0], [1, 0], [1, 1], [2, 1], [2, 2], [3, 2], [3, 3], [0, 3]] and len(got) == 3
    four = raster.mask_to_polygons(px.where("tile_id = 2"), "m").collect()
    assert sorted(tuple(map(tuple, r.points)) for r in four) == [((0, 0), (2, 0), (2, 2), (0, 2)), ((2, 2), (4, 2), (4, 4), (2, 4))]
    thin = raster.mask_to_polygons(px, "m", simplify=0.8, connectivity=8).where("tile_id = 3").first().points
    assert thin == [[0, 0], [2, 2], [3, 3], [0, 3]]
    assert raster.mask_to_polygons(px.where("false"), "m").count() == 0


def test_a_long_outline_is_ranked(spark):
    """A comb of 60 teeth: its outline has a corner for each step, in order, and thinning keeps within its tolerance."""
    n = 60
    rows = ["#" * (2 * n)] + ["".join("#." for _ in range(n))] * 5
    r = raster.mask_to_polygons(pixels(spark, {1: rows}), "m").first()
    assert len(r.points) == 4 * n + 2 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(r.points, r.points[1:] + r.points[:1], strict=True))
    assert raster.mask_to_polygons(pixels(spark, {1: rows}), "m", simplify=20.0).first().points[0] == [0, 0]
