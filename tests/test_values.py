"""Answers of the operators that no SQL states, worked out here in plain Python or by construction."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from standmap.functions import geometry as geo
from standmap.operators import learn, raster, select, spatial, splits


def table(spark, **bands):
    """Pixels of one tile from rasters of equal shape."""
    (h, w), names = next(iter(bands.values())).shape, list(bands)
    kind = {"b": "boolean", "f": "double", "i": "int", "u": "int"}
    rows = [(1, y, x, *(bands[n][y, x].item() for n in names)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "tile_id long, y int, x int, " + ", ".join(f"{n} {kind[bands[n].dtype.kind]}" for n in names))


def back(df, col, shape):
    out = np.zeros(shape)
    for r in df.select("y", "x", col).collect():
        out[r.y, r.x] = r[col]
    return out


def dilated(m, times=1):
    for _ in range(times):
        p = np.pad(m, 1)
        m = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return m


def eroded(m, times=1):
    for _ in range(times):
        p = np.pad(m, 1)
        m = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return m


def distance(m):
    ys, xs = np.nonzero(m)
    y, x = np.mgrid[: m.shape[0], : m.shape[1]]
    return np.sqrt(((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(-1))


def blurred(v, sigma):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    line = lambda a: np.convolve(np.pad(a, r, "symmetric"), w / w.sum(), "valid")
    return np.apply_along_axis(line, 0, np.apply_along_axis(line, 1, v))


def test_affines_are_rotation_shear_and_scale_within_bounds(spark):
    polys = spark.createDataFrame([(i,) for i in range(40)], "poly_id long")
    phases = spark.createDataFrame([(1, 10.0, 5.0, 2.0, 0.05), (2, 40.0, 20.0, 8.0, 0.2)], "phase int, max_shift double, max_turn double, max_shear double, max_scale double")
    rows = geo.affine_augment(polys, phases, 3, 7).collect()
    bound = {r.phase: r for r in phases.collect()}
    assert len(rows) == 240 == len({(r.a, r.b, r.c, r.d) for r in rows}) and {r.n for r in rows} == {0, 1, 2}
    for r in rows:
        most = bound[r.phase]
        turn, sx = math.atan2(r.c, r.a), math.hypot(r.a, r.c)  # A = R * Sh * S: its first column is R's, scaled
        across, along = math.cos(turn) * r.b + math.sin(turn) * r.d, -math.sin(turn) * r.b + math.cos(turn) * r.d
        assert abs(math.degrees(turn)) <= most.max_turn and abs(sx - 1) <= most.max_scale + 1e-12 and abs(along - 1) <= most.max_scale + 1e-12
        assert abs(math.degrees(math.atan2(across, along))) <= most.max_shear + 1e-9 and max(abs(r.tx), abs(r.ty)) <= most.max_shift
    wide = [abs(math.degrees(math.atan2(r.c, r.a))) for r in rows if r.phase == 2]
    assert max(wide) > 15 and min(wide) < 5  # the draws fill their range
    assert sorted(map(tuple, geo.affine_augment(polys, phases, 3, 7).collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, geo.affine_augment(polys, phases, 3, 8).collect())) != sorted(map(tuple, rows))


def test_confirmed_negatives_equal_a_loop(spark):
    """A square survey with a hole, features as triangles, tiles, and imagery for most: each condition by hand, then greedy spacing."""
    rng = np.random.default_rng(8)
    cand = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-500, 10_500, (300, 2)).round(1).tolist())]
    ring = lambda i, kind, a, b: [(i, kind, k, x, y) for k, (x, y) in enumerate(((a, a), (b, a), (b, b), (a, b)))]
    regions = ring(1, "surveyed", 0.0, 10_000.0) + ring(2, "not_flown", 4000.0, 5000.0)
    spots = rng.uniform(0, 10_000, (30, 2)).tolist()
    vert = [(i, k, x + dx, y + dy) for i, (x, y) in enumerate(spots) for k, (dx, dy) in enumerate(((0.0, 0.0), (60.0, 0.0), (0.0, 60.0)))]
    tiles = rng.uniform(0, 10_000, (10, 2)).tolist()

    def clear(x, y, r=300):
        """No triangle meets the square of half side r: not its box's corners' side, nor beyond its slope."""
        return not any(x - r <= px + 60 and x + r >= px and y - r <= py + 60 and y + r >= py and (max(x - r, px) - px) + (max(y - r, py) - py) <= 60 for px, py in spots)

    kept = []
    for i, x, y in cand:
        inside = 150 < x < 9850 and 150 < y < 9850 and not (3850 <= x <= 5150 and 3850 <= y <= 5150)
        if inside and clear(x, y) and i % 7 and all(math.hypot(x - a, y - b) >= 800 for a, b in tiles) and all(math.hypot(x - a, y - b) >= 500 for _, a, b in kept):
            kept.append((i, x, y))
    df = lambda rows, names: spark.createDataFrame(rows, names)
    got = spatial.confirmed_negatives(
        df(cand, "cand_id long, cx double, cy double"), df(regions, "region_id long, kind string, k long, x double, y double"), df(vert, "poly_id long, k long, x double, y double"),
        df(tiles, "x double, y double"), df([(i,) for i, *_ in cand if i % 7], "cand_id long"), spacing=500,
    ).collect()
    assert {r.cand_id for r in got} == {i for i, *_ in kept} and len(kept) > 20
    assert all((r.xmin, r.ymax, r.role, r.window_m) == (r.cx - 150, r.cy + 150, "negative", 300.0) for r in got)


def test_proximity_equals_its_steps(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:40, :33]
    v = np.clip(np.exp(-((y - 18) ** 2 + (x - 15) ** 2) / 90) + 0.05 * rng.random((40, 33)) - 0.03, 0, 1)
    strong = v > np.percentile(v[v > 0.01], 65)
    strong = dilated(eroded(strong))
    edge = dilated(strong) & ~eroded(strong)
    got = back(raster.proximity_map(table(spark, v=v), "v"), "proximity", v.shape)
    assert edge.sum() >= 10 and np.allclose(got, blurred(distance(edge), 2), atol=1e-9)
    assert (back(raster.proximity_map(table(spark, v=v * 0), "v"), "proximity", v.shape) == 50).all()


def test_weak_labels_are_strong_stress_grown_once(spark):
    v = np.random.default_rng(4).random((30, 30))
    out = raster.weak_label(table(spark, v=v), "v", turn=0.0, shift=0.0, looser=0.0, cut=0.5)
    weak = dilated(v > np.percentile(v, 88))
    assert (back(out, "weak", v.shape) == weak).all()
    # neither turned nor moved nor grown, so the corrupted copy is a blur of it, with one sigma for the tile
    corrupt = back(out, "corrupt", v.shape).astype(bool)
    assert any((corrupt == (blurred(weak.astype(float), s) > 0.5)).mean() > 0.99 for s in np.linspace(1, 4, 61))


def test_drafts_outline_strong_scores_near_the_prior(spark):
    """A strong square inside the prior and one far away: only the first is drawn, by its own outline but for the corners that opening takes."""
    v, prior = np.full((60, 60), 0.001), np.zeros((60, 60), bool)
    v[10:22, 12:26], v[40:56, 44:58], prior[8:24, 10:30] = 0.9, 0.9, True
    got = raster.draft_regions(table(spark, v=v, prior=prior), "v", "prior", simplify_frac=0.0).collect()
    assert len(got) == 1
    xs, ys = (np.array([p[i] for p in got[0].points]) for i in (0, 1))
    assert (xs.min(), xs.max(), ys.min(), ys.max()) == (12, 26, 10, 22)
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(got[0].points, got[0].points[1:] + got[0].points[:1], strict=True)) / 2
    assert area == got[0].blob_px and 12 * 14 - 12 <= area <= 12 * 14


def test_clusters_of_separate_places(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 100.0 * (i % 4) + float(a), 80.0 * (i % 4 // 2) + float(b)) for i, (a, b) in enumerate(rng.normal(0, 2, (120, 2)))]
    got = {r.poly_id: r.area_cluster for r in splits.spatial_clusters(spark.createDataFrame(rows, "poly_id long, cx double, cy double"), 4).collect()}
    assert len(set(got.values())) == 4 and all(got[i] == got[i % 4] for i in got)


def forest_pixels(spark, tiles):
    """Tiles with a square of bright red damage in green forest, in and around the prior."""
    rng = np.random.default_rng(10)
    rows = []
    for t in tiles:
        for y in range(24):
            for x in range(24):
                hit = 6 <= y < 16 and 5 + t % 3 <= x < 15 + t % 3
                noise = rng.integers(-12, 13, 4).tolist()
                r, g, b, nir = (max(0, v + e) for v, e in zip((190, 80, 60, 90) if hit else (60, 130, 60, 200), noise, strict=True))
                rows.append((t, y, x, r, g, b, nir, hit, False, 3 <= y < 20 and 2 <= x < 22))
    return spark.createDataFrame(rows, "tile_id long, y int, x int, r int, g int, b int, nir int, gt boolean, ign boolean, prior boolean")


def test_the_forest_learns_and_drafts_are_the_damage(spark):
    px = learn.pixel_features(forest_pixels(spark, range(4))).cache()
    scored = learn.pixel_classifier(px.where("tile_id < 2"), px.where("tile_id >= 2"), trees=10)
    s = scored.groupBy("gt").agg(F.avg("score").alias("mean"), F.count_if((F.col("score") > 0.5) == F.col("gt")).alias("right"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.right for r in s) > 0.99 * sum(r.n for r in s) and {r.gt: r.mean > 0.9 if r.gt else r.mean < 0.1 for r in s} == {True: True, False: True}
    drafts = learn.learned_drafts(px, spark.createDataFrame([(0,), (1,)], "tile_id long"), trees=10, simplify_frac=0.0).collect()
    assert sorted(r.tile_id for r in drafts) == [2, 3]
    for r in drafts:
        xs, ys = [p[0] for p in r.points], [p[1] for p in r.points]
        assert (min(xs), max(xs), min(ys), max(ys)) == (5 + r.tile_id % 3, 15 + r.tile_id % 3, 6, 16) and r.blob_px == 88  # opened twice, a corner loses three pixels
    held = learn.leave_one_out_score(px, max_tiles=2, trees=10, per_class=100).collect()
    assert len(held) == 2 and all(r.iou > 0.85 for r in held)


def test_held_out_trees_equal_separate_fits(spark):
    """With a fold a tile, scores are those of forests fitted by hand without the tile; with fewer folds no forest sees a tile that it scores."""
    px = learn.pixel_features(forest_pixels(spark, range(5))).cache()
    held = spark.createDataFrame([(0,), (2,), (4,), (4,)], "tile_id long")
    fold = {r.tile_id: r.fold[0] for r in learn.held_out_folds(held, 20).collect()}
    assert sorted(fold) == [0, 2, 4] and sorted(fold.values()) == [0, 1, 2]
    got = {(r.tile_id, r.y, r.x): r.score for r in learn.held_out_scores(px, held, trees=6, per_class=60).collect()}
    assert len(got) == 3 * 24 * 24
    for t, f in fold.items():
        alone = learn.pixel_classifier(select.per_class_sample(px.where(F.col("tile_id") != t), "gt", 60), px.where(F.col("tile_id") == t), trees=6, seed=42 + f)
        want = [(r.score, got[r.tile_id, r.y, r.x]) for r in alone.collect()]
        assert sum(abs(a - b) < 0.2 for a, b in want) > 0.98 * len(want)  # bags are drawn by partition, so trees differ a little
    for folds, draws in ((2, 1), (2, 3), (3, 2)):
        dealt = learn.held_out_folds(px, folds, draws).collect()
        for d in range(draws):
            sizes = [sum(r.fold[d] == f for r in dealt) for f in range(folds)]
            assert sum(sizes) == 5 and max(sizes) - min(sizes) <= 1
    every = learn.leave_one_out_score(px, max_tiles=None, trees=6, per_class=100, folds=2, draws=2).collect()
    assert sorted(r.tile_id for r in every) == list(range(5)) and all(r.iou > 0.85 for r in every)
    assert learn.leave_one_out_score(px.limit(0), trees=4).count() == 0
    with pytest.raises(ValueError):
        learn.held_out_scores(px, held, trees=5, draws=2)


def test_no_forest_sees_the_tile_that_it_scores(spark, monkeypatch):
    """The tiles that each forest learns from and those that it scores are disjoint, and each tile is scored once a draw."""
    seen = []

    def spy(train, score, trees, seed):
        tiles = [{r[0] for r in df.select("tile_id").distinct().collect()} for df in (train, score)]
        seen.append((*tiles, trees))
        return score.withColumn("score", F.lit(0.5))

    monkeypatch.setattr(learn, "pixel_classifier", spy)
    px = learn.pixel_features(forest_pixels(spark, range(7)))
    held = spark.createDataFrame([(t,) for t in range(6)], "tile_id long")
    out = learn.held_out_scores(px, held, folds=3, draws=2, trees=12, per_class=5)
    assert out.count() == 6 * 24 * 24 and len(seen) == 6 and {n for _, _, n in seen} == {6}
    assert all(a | b == set(range(7)) and not a & b and 6 in a for a, b, _ in seen)
    assert sorted(t for _, b, _ in seen for t in b) == sorted([*range(6)] * 2)
