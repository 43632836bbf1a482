"""Plans and steps whose cost must not outgrow the input."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from standmap.operators import raster
from standmap.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["box_stats", "gaussian_blur", "gap_and_damage_map", "stress_map", "region_iou", "mask_contour"])
def test_neighbourhoods_go_by_tile_without_a_shuffle_of_pixels(name, spark):
    found = plan(QUERIES[name](spark, SF))
    assert "Window" not in found and "REPARTITION_BY_COL" not in found and "REPARTITION_BY_NUM" in found


def joins(df) -> list[str]:
    return [line for line in plan(df).splitlines() if "Join" in line]


def test_blobs_are_not_broadcast(spark):
    px = spark.range(64).selectExpr("1L as tile_id", "cast(id div 8 as int) as y", "cast(id % 8 as int) as x", "id % 3 = 0 as m")
    assert "SortMergeJoin" in joins(raster.drop_small_blobs(px, "m", 0.01))[0]


def test_patches_are_not_broadcast(spark):
    found = [j for j in joins(QUERIES["merge_patch_boxes"](spark, SF)) if "patch_row" in j]
    assert found and all("SortMergeJoin" in j for j in found)


def test_sizes_of_patches_are_not_broadcast(spark):
    """Tiles are few bytes a row on disk, so that their patches passed for a small table."""
    assert "Broadcast" not in plan(QUERIES["merge_patch_boxes"](spark, SF))


@pytest.mark.parametrize("block", [4, 6, 512])
def test_squares_of_a_raster_give_what_the_whole_gives(block, spark):
    from pyspark.sql import types as T

    from standmap.operators.blocks import blockwise, weighted

    px = spark.range(13 * 11).selectExpr("1L as tile_id", "cast(id div 11 as int) as y", "cast(id % 11 as int) as x", "cast(id * 7919 % 101 as double) as v")

    def run(v):
        import numpy as np

        return [weighted(v, np.ones((1, 5)), 2)]

    out = {(r.y, r.x): r.s for r in blockwise(px, ["v"], 2, [T.StructField("s", T.DoubleType())], run, block).collect()}
    at = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    v = {(r.y, r.x): r.v for r in px.collect()}
    assert out == {(y, x): sum(v[at(y + i, 13), at(x + j, 11)] for i in range(-2, 3) for j in range(-2, 3)) for y in range(13) for x in range(11)}


def test_struck_points_make_no_pairs(spark):
    from standmap.operators import spatial

    cand = spark.range(4000).selectExpr("id as cand_id", "id % 60 * 1.0d as cx", "id div 60 * 1.0d as cy")
    found = plan(spatial.min_spacing_to(cand, cand.selectExpr("cx as x", "cy as y"), 800))
    assert "Join [gx" not in found and spatial.min_spacing_to(cand, cand.selectExpr("cx as x", "cy as y"), 800).count() == 0


@pytest.mark.parametrize("first", [1, 7, 4096])
def test_thinning_in_parts_is_thinning_in_order(first, spark, monkeypatch):
    from standmap.operators import spatial

    given = []
    near = spatial._near
    monkeypatch.setattr(spatial, "_near", lambda a, b, d: given.append(a.count()) or near(a, b, d))
    rows = [(i, float(i * 7919 % 401), float(i * 104729 % 397)) for i in range(600)]
    want = []
    for i, x, y in rows:
        if all((x - a) ** 2 + (y - b) ** 2 >= 1600 for _, a, b in want):
            want.append((i, x, y))
    out = spatial.spaced_sample(spark.createDataFrame(rows, "cand_id long, cx double, cy double"), 40, first=first)
    assert sorted(map(tuple, out.collect())) == want
    assert first == 4096 or max(given) <= 600 * 7 // 8


def test_pairs_of_polygons_are_shuffled_once(spark):
    from standmap.operators import spatial

    v = spark.range(80).selectExpr("id div 8 as poly_id", "id % 8 as k", "cos(id % 8 * pi() / 4) as x", "sin(id % 8 * pi() / 4) as y")
    assert plan(spatial.polygon_overlap(v, v.selectExpr("poly_id", "k", "x + 0.5 as x", "y"))).count("Exchange") == 1


@pytest.mark.parametrize("pieces", [1, 7, 1 << 20])
def test_overlaps_of_many_cornered_pairs(pieces, spark, monkeypatch):
    """Combs of 40 teeth, one of them turned the other way, against their areas; a pair without an id, or with one side, has no row."""
    import numpy as np
    import pyarrow as pa

    from standmap.operators import spatial

    monkeypatch.setattr(spatial, "PIECES", pieces)
    teeth = [(x, y) for i in range(40) for x, y in ((i, 0), (i, 1 + i % 3), (i + 0.5, 1 + i % 3), (i + 0.5, 0))] + [(40, 0), (40, -1), (0, -1)]
    area = 40 + sum(0.5 * (1 + i % 3) for i in range(40))
    rows = [(1, part, k, x, y + d) for part, d, ps in ((False, 0.0, teeth), (True, 0.5, teeth[::-1])) for k, (x, y) in enumerate(ps)]
    rows += [(2, False, k, x, y) for k, (x, y) in enumerate(teeth)]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("poly_id", "part", "k", "x", "y"))})
    (got,) = spatial._overlaps(table, "poly_id").to_pylist()
    # moved up by 0.5: the back shares half its height, each tooth its height less 0.5, and a tooth's foot half of the back's rest
    shared = 20 + sum(0.5 * (0.5 + i % 3) for i in range(40)) + 40 * 0.5 * 0.5
    assert got["poly_id"] == 1 and np.isclose(got["iou_raw"], shared / (2 * area - shared)) and np.isclose(got["iou_shift"], 1) and np.isclose(got["iou_scaled"], 1)
    assert np.isclose(got["shift_m"], 0.5) and np.isclose(got["area_ratio"], 1)
    v = spark.createDataFrame([(None if i == 1 else i, k, float(x), float(y)) for i in (1, 2) for k, (x, y) in enumerate(teeth)], "poly_id long, k long, x double, y double")
    assert [r.poly_id for r in spatial.polygon_overlap(v, v).collect()] == [2]


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_rasters_come_whole_whatever_the_frames(rows):
    import pandas as pd

    from standmap.operators.blocks import whole_rasters

    ids = [1] * 4 + [2] + [3] * 7 + [None] * 2 + [5]
    all_ = pd.DataFrame({"tile_id": pd.array(ids, dtype="object"), "x": range(len(ids))})
    found = [t for ts in whole_rasters(iter([all_.iloc[i : i + rows] for i in range(0, len(ids), rows)])) for t in ts]
    assert [t["x"].tolist() for t in found] == [[0, 1, 2, 3], [4], list(range(5, 12)), [12, 13], [14]]


@pytest.mark.parametrize("name", ["score_tiles", "alignment_search"])
def test_tiles_have_no_group_of_their_own(name, spark):
    found = plan(QUERIES[name](spark, SF))
    assert "FlatMapGroups" not in found and "REPARTITION_BY_COL" not in found


def test_views_are_not_sorted(spark):
    found = plan(QUERIES["tta_average"](spark, SF))
    assert "Window" not in found and "SortMergeJoin" not in found and "REPARTITION_BY_COL" not in found


def test_both_distances_of_the_prior_go_together(spark):
    assert plan(QUERIES["soft_prior"](spark, SF)).count("MapInArrow") == 2


def test_parts_grow_with_tiles(spark, monkeypatch):
    """A task's pixels stay as many however many tiles there are, and neighbourhoods still need no shuffle."""
    from standmap.sources import fixtures

    monkeypatch.setattr(fixtures, "TILES", 10)
    n = -(-spark.read.parquet(f"{SF}/part.parquet").count() // 10)
    try:
        assert fixtures.Views(spark, SF).pixels.rdd.getNumPartitions() == n > 4
        assert "REPARTITION_BY_COL" not in plan(QUERIES["box_stats"](spark, SF)) and f", {n})" in plan(QUERIES["box_stats"](spark, SF))
    finally:
        spark.conf.unset("standmap.parts")


@pytest.mark.parametrize("name", ["crop_labels", "crop_summary", "crop_pixels"])
def test_tiles_are_dealt_out_before_they_are_spread_into_crops(name, spark):
    lines = plan(QUERIES[name](spark, SF)).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    crops = [i for i, line in enumerate(lines) if "Generate posexplode" in line]
    assert crops
    for i in crops:  # between crops and the file they come from lies an exchange by tile
        below = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(lines[i])), len(lines))
        assert any("hashpartitioning(tile_id" in line for line in lines[i:below])


def test_shapes_are_parsed_once_and_fill_without_windows(spark):
    """The JSON of a shape isn't parsed again for each number of its ring, crossings are neither shuffled nor sorted."""
    found = plan(QUERIES["shapes_to_masks"](spark, SF))
    assert 1 <= found.count("from_json") <= 2 and "Window" not in found and "Sort " not in found
    assert "Window" not in plan(QUERIES["rasterize"](spark, SF))


@pytest.mark.parametrize("together", [1, 40, 1 << 20])
def test_fills_in_parts_are_parity_at_centres(together, spark, monkeypatch):
    """Rings within rings, rings beyond the raster, vertices on centres, unknown vertices and ids, however many polygons go together."""
    import numpy as np

    monkeypatch.setattr(raster, "CROSSINGS", together)
    draw = np.random.default_rng(7)
    rings = {(None if t == 3 else t, ring): [(float(x), float(y)) for x, y in draw.integers(-6, 40, (n, 2)) / 2] for t in range(6) for ring, n in ((0, 5 + t), (1, 4))}
    rows = [(t, ring, k, x, y) for (t, ring), ps in rings.items() for k, (x, y) in enumerate(ps)] + [(9, 0, k, None, float(k)) for k in range(4)]
    draw.shuffle(rows)
    v = spark.createDataFrame([(None if t is None else int(t), int(r), int(k), None if x is None else float(x), float(y)) for t, r, k, x, y in rows], "tile_id long, ring int, k int, x double, y double")

    def inside(t, y, x):  # the crossings to the left of a centre, those on it included
        n = 0
        for (of, _), ps in rings.items():
            if of == t:
                n += sum((ay <= y + 0.5) != (by <= y + 0.5) and ax + (y + 0.5 - ay) * (bx - ax) / (by - ay) <= x + 0.5 for (ax, ay), (bx, by) in zip(ps, ps[1:] + ps[:1], strict=True))
        return n % 2 == 1

    got = [tuple(r) for r in raster.rasterize(v.repartition(3), 13, 11).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, y, x) for t in (0, 1, 2, None, 4, 5) for y in range(13) for x in range(11) if inside(t, y, x)}


def test_layers_meet_as_bytes_and_no_tile_is_a_group(spark):
    import re

    found = plan(QUERIES["read_raster_layers"](spark, SF))
    assert "Join" not in found and "Broadcast" not in found and len(re.findall("MapInArrow", found)) == 1


@pytest.mark.parametrize("together", [1, 1 << 17])
def test_layers_of_other_sizes_than_the_picture(together, spark, tmp_path, monkeypatch):
    """More lines than a strip, a mask larger and a prior smaller than the picture, and layers of a tile without picture."""
    import functools

    from standmap.sources import io as layers

    monkeypatch.setattr(layers, "_pixels", functools.partial(layers._pixels, together=together))
    sizes = {"images": (130, 3), "masks": (140, 5), "priors": (70, 2), "nir": (130, 3)}
    rows = [(1, y, x, name) for name, (h, w) in sizes.items() for y in range(h) for x in range(w)] + [(2, 0, 0, "masks"), (3, 0, 0, "images")]
    v = "(7 * y + x) % 256"
    px = spark.createDataFrame(rows, "tile_id long, y int, x int, name string").selectExpr("*", f"{v} as r", f"{v} as g", f"{v} as b", f"{v} as nir", "(y + x) % 3 = 0 as gt", "(y + x) % 3 = 0 as prior", "false as ign")
    for name in sizes:
        layers.write_raster_layers(px.where(f"name = '{name}'"), str(tmp_path), [name])
    got = {(r.tile_id, r.y, r.x): (r.r, r.g, r.b, r.gt, r.prior, r.nir) for r in layers.read_raster_layers(spark, str(tmp_path), list(sizes)).collect()}
    value, flag = lambda y, x: (7 * y + x) % 256, lambda y, x: (y + x) % 3 == 0
    want = {("1", y, x): (*[value(y, x)] * 3, flag(y, x), y < 70 and x < 2 and flag(y, x), value(y, x)) for y in range(130) for x in range(3)}
    assert got == want | {("3", 0, 0): (0, 0, 0, False, False, None)}


def test_a_forest_learns_in_parts_that_its_rows_alone_decide(spark):
    """Large samples are dealt out, and how the rows came doesn't change the forest."""
    from standmap.operators import learn

    assert learn._parts(0) == learn._parts(5_000) == 1 and learn._parts(400_000) == 24 and learn._parts(100_000_000) == 100
    px = spark.range(22_000).selectExpr("id div 100 as tile_id", "cast(id div 10 % 10 as int) as y", "cast(id % 10 as int) as x", "id * 7919 % 251 < 90 as gt", *(f"cast(id * {m} % 251 as double) as {c}" for m, c in zip((7, 31, 101, 7919, 13, 57, 83), learn.FEATURES, strict=True)))
    score = lambda train: [r.score for r in learn.pixel_classifier(train, px.where("tile_id < 3"), trees=3, depth=4).orderBy("tile_id", "y", "x").collect()]
    assert score(px.coalesce(1)) == score(px.orderBy("r").repartition(5))


def test_proximity_takes_one_pass_and_is_that_of_strips(spark):
    """Rasters of two shapes, one with too little signal and one with unknown values; strips are taken if rasters are cut."""
    rows = [(t, y, x, None if t == 3 and x == 4 else float(t != 2) * ((7 * y * y + 13 * x + t) % 97) / (600 if (y // 5 + x // 6) % 2 else 97)) for t, h, w in ((1, 20, 31), (2, 20, 31), (3, 23, 17), (4, 20, 31)) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "tile_id long, y int, x int, v double")
    one, strips = (raster.proximity_map(px, "v", sigma=1.5, least_boundary=2, block=b) for b in (1024, 16))
    assert plan(one).count("MapInArrow") == 1 and plan(strips).count("MapInArrow") > 1
    got, want = ({(r.tile_id, r.y, r.x): r.proximity for r in d.collect()} for d in (one, strips))
    assert got == pytest.approx(want) and len({v for (t, *_), v in got.items() if t == 1}) > 5 and {v for (t, *_), v in got.items() if t == 2} == {50.0}
    assert raster.proximity_map(px.where("false"), "v").count() == 0


def test_weak_labels_take_one_pass_and_are_those_of_squares(spark):
    rows = [(t, y, x, None if t == 3 and x == 4 else (7 * y * y + 13 * x + t) % 97 / 97) for t, h, w in ((1, 20, 31), (2, 23, 17), (3, 20, 31), (4, 20, 31), (5, 23, 17)) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "tile_id long, y int, x int, v double")
    one, squares = (raster.weak_label(px, "v", pct=70, shift=6, block=b) for b in (1024, 16))
    assert one.columns == squares.columns and plan(one).count("MapInArrow") == 1 and plan(squares).count("MapInArrow") > 1
    got, want = (sorted(map(tuple, d.select("tile_id", "y", "x", "weak", "corrupt").collect())) for d in (one, squares))
    assert got == want and {r[3:] for r in got} == {(a, b) for a in (False, True) for b in (False, True)}


def _masks(spark):
    """Rasters of three shapes with holes, touching corners, blobs of a pixel and, in tile 4, no pixel; one without an id."""
    rows = [(t, y, x, (t != 4) and (7 * y * y + 13 * x * x + 5 * x * y + (t or 0)) % 11 < 6, (17 * y + 29 * x + (t or 0)) % 97 / 97 if x != 5 else None) for t, h, w in ((1, 20, 31), (2, 23, 17), (3, 20, 31), (4, 20, 31), (5, 1, 9), (None, 3, 3)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "tile_id long, y int, x int, m boolean, v double")


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("more", [{}, {"simplify": 1.0, "min_area": 3}, {"simplify_frac": 0.05, "min_frac": 0.01}])
def test_outlines_take_one_pass_and_are_those_of_blocks(connectivity, more, spark):
    px = _masks(spark)
    one, blocks = (raster.mask_to_polygons(px, "m", connectivity=connectivity, block=b, **more) for b in (1024, 16))
    assert plan(one).count("MapInArrow") == 1 and "MapInArrow" not in plan(blocks) and one.dtypes == blocks.dtypes
    got, want = (sorted((r.tile_id, r.blob, r.blob_px, r.points) for r in d.collect()) for d in (one, blocks))
    assert got == want and {t for t, *_ in got} >= {1, 2, 3}
    assert raster.mask_to_polygons(px.where("not m"), "m").count() == 0


def test_drafts_take_one_pass_and_are_those_of_squares(spark):
    px = _masks(spark).withColumns({"m": F.col("m") & (F.col("tile_id") != 3), "v": F.expr("if(x = 8, null, (y div 5 + x div 6) % 2 * 0.5 + (7 * y + 3 * x) % 10 / 100)")})
    one, blocks = (raster.draft_regions(px, "v", "m", 40, near=0.1, opened=1, closed=1, block=b) for b in (1024, 16))
    got, want = (sorted((r.tile_id, r.blob, r.blob_px, r.points) for r in d.collect()) for d in (one, blocks))
    assert got == want and len({t for t, *_ in got}) > 2 and one.dtypes == blocks.dtypes


@pytest.mark.parametrize("name", ["mask_to_polygons", "draft_regions"])
def test_polygons_of_small_rasters_are_neither_written_nor_joined(name, spark):
    found = plan(QUERIES[name](spark, SF))
    assert found.count("MapInArrow") == 1 and "SortMergeJoin" not in found and "REPARTITION_BY_COL" not in found


def test_pixels_meet_their_crops_by_tile(spark):
    """Crops that the grid lacks, a far edge off the regular offsets, unknown layers; pixels are never shuffled by crop."""
    sizes = {1: 10, 2: 7, 3: 4, 4: 9}
    px = spark.createDataFrame([(t, y, x, None if x == 3 else 100 * y + x) for t, n in sizes.items() for y in range(n) for x in range(n)], "tile_id long, y int, x int, v int")
    tiles = spark.createDataFrame([(t, "damage" if t < 4 else "negative", float(n), n) for t, n in sizes.items()], "tile_id long, role string, window_m double, size_px int")
    grid = raster.crop_grid(tiles, gsd=1.0, crop=4).where("tile_id <> 2 and (crop_row + crop_col) % 3 <> 1")
    out = raster.crop_pixels(grid, px)
    want = {(g.tile_id, y, x, None if g.x0 + x == 3 else 100 * (g.y0 + y) + g.x0 + x, g.crop_id) for g in grid.collect() for y in range(4) for x in range(4)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and {t for t, *_ in got} == {1, 3, 4} and out.columns == ["tile_id", "y", "x", "v", "crop_id"]
    assert not any("crop_row" in line for line in plan(out).splitlines() if "Exchange" in line)
    assert "hashpartitioning(crop_id" not in plan(QUERIES["crop_pixels"](spark, SF))


@pytest.mark.parametrize("name", ["stress_map", "box_stats"])
def test_squares_are_not_sent_to_python(name, spark):
    """A pass over pixels costs by their columns: squares are taken where the means are."""
    lines = plan(QUERIES[name](spark, SF)).splitlines()
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("__q#" in line for line in lines[at + 1 :])
