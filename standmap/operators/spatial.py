"""Spatial joins by grid cells: an equi-join on cells, then the exact test."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from standmap.operators.blocks import new_groups, whole
from standmap.sources.store import dealt, materialize, quantiles, row_numbers


def _edges(vert: DataFrame, keys: list[str]) -> DataFrame:
    w, first = Window.partitionBy(*keys).orderBy("k"), Window.partitionBy(*keys)
    return vert.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.min_by("x", "k").over(first)), "ny": F.coalesce(F.lead("y").over(w), F.min_by("y", "k").over(first))})


#: Sides of the blocks of candidates that are thinned at a time, in distances.
BLOCK = 64
#: Where cells begin, off the round numbers on which edges and points stand.
SHIFT = 0.31830988618379067


def _cell(v: Column, cell: float) -> Column:
    return F.floor((v - SHIFT) / cell)


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(_cell(lo, cell), _cell(hi, cell)))


def _passed(e: DataFrame, cell: float) -> DataFrame:
    """Edges (x, y, nx, ny) spread over the cells (row, col) that they pass: the rows that they span, and the columns in each row."""
    rows = e.withColumn("row", _cells(F.least("y", "ny"), F.greatest("y", "ny"), cell))
    lo_y, hi_y = F.greatest(F.least("y", "ny"), F.col("row") * cell + SHIFT), F.least(F.greatest("y", "ny"), (F.col("row") + 1) * cell + SHIFT)
    flat = F.col("y") == F.col("ny")
    on = lambda v: F.when(flat, F.col("x")).otherwise(F.col("x") + (v - F.col("y")) * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y")))
    x0 = F.when(flat, F.least("x", "nx")).otherwise(F.least(on(lo_y), on(hi_y)))
    x1 = F.when(flat, F.greatest("x", "nx")).otherwise(F.greatest(on(lo_y), on(hi_y)))
    return rows.withColumn("col", _cells(x0 - 1, x1 + 1, cell))


def _touches(r: float) -> Column:
    """Whether an edge meets the box of half side ``r`` around (cx, cy): cut by the box's sides in turn, something of it is left (Liang-Barsky)."""
    t0, t1, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for d, p, mid in ((F.col("nx") - F.col("x"), F.col("x"), F.col("cx")), (F.col("ny") - F.col("y"), F.col("y"), F.col("cy"))):
        a, b = (mid - r - p) / F.nullif(d, F.lit(0)), (mid + r - p) / F.nullif(d, F.lit(0))
        t0, t1 = F.greatest(t0, F.least(a, b)), F.least(t1, F.greatest(a, b))  # greatest and least pass over null
        ok = ok & ((d != 0) | (F.abs(p - mid) <= r))
    return ok & (t0 <= t1)


def cell_index(edges: DataFrame, cell: float) -> DataFrame:
    """Rings (region_id, kind, x, y, nx, ny) by cell: (region_id, kind, row, col, x, y, nx, ny), the edges that pass a cell, and one row without an edge for each cell whose lower left corner the ring holds.

    A cell without rows is outside, one with only the row without an edge is inside, one with edges is on the boundary.
    Along the lower border of a row of cells the ring's crossings, in order, are pairs between which corners are inside.
    """
    w = Window.partitionBy("region_id", "kind", "row").orderBy("at")
    up = lambda v: F.ceil((v - SHIFT) / cell)
    lines = edges.withColumns({"lo": up(F.least("y", "ny")), "hi": up(F.greatest("y", "ny")) - 1}).where("lo <= hi").withColumn("row", F.explode(F.sequence("lo", "hi")))
    at = F.col("x") + (F.col("row") * cell + SHIFT - F.col("y")) * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y"))
    spans = lines.select("region_id", "kind", "row", at.alias("at")).withColumns({"rn": F.row_number().over(w), "to": F.lead("at").over(w)}).where("rn % 2 = 1")
    spans = spans.withColumns({"lo": up(F.col("at")), "hi": up(F.col("to")) - 1}).where("lo <= hi")
    none = [F.lit(None).cast("double").alias(c) for c in ("x", "y", "nx", "ny")]
    inside = spans.select("region_id", "kind", "row", F.explode(F.sequence("lo", "hi")).alias("col"), *none)
    return inside.unionByName(_passed(edges, cell).select(*inside.columns))


def _held_by(points: DataFrame, index: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """(keys, region_id, kind) of points (keys, px, py) and the rings of :func:`cell_index` that hold them.

    From its cell's corner a path leads up and then right to the point; an edge that it crosses turns inside to outside.
    Points without an edge in their cell need no test.
    """
    here = points.withColumns({"row": _cell(F.col("py"), cell), "col": _cell(F.col("px"), cell)}).join(index, ["row", "col"])
    x0, y0 = F.col("col") * cell + SHIFT, F.col("row") * cell + SHIFT
    x, y, nx, ny, px, py = (F.col(c) for c in ("x", "y", "nx", "ny", "px", "py"))
    spans = lambda a, b, v: ((a <= v) & (v < b)) | ((b <= v) & (v < a))
    on_row, on_side = x + (py - y) * (nx - x) / F.nullif(ny - y, F.lit(0.0)), y + (x0 - x) * (ny - y) / F.nullif(nx - x, F.lit(0.0))
    right = spans(y, ny, py) & (on_row > x0) & (on_row <= px)
    up = spans(x, nx, x0) & (on_side > y0) & (on_side <= py)
    turns = F.when(x.isNull(), 1).otherwise(F.coalesce(right, F.lit(False)).cast("int") + F.coalesce(up, F.lit(False)).cast("int"))
    return here.groupBy(*keys, "region_id", "kind").agg((F.sum(turns) % 2 == 1).alias("odd")).where("odd").drop("odd")


def union_boundary(edges: DataFrame, index: DataFrame, cell: float) -> DataFrame:
    """What of the rings' edges (region_id, kind, x, y, nx, ny), with their :func:`cell_index`, bounds their union: (x, y, nx, ny).

    Edges are cut where other rings meet them. A part bounds the union if, of two points close to its middle on either
    side, one lies in some ring and the other in none.
    """
    e = materialize(edges.withColumn("edge", F.monotonically_increasing_id()))
    cells = _passed(e, cell)
    o = cells.select(*(F.col(c).alias(f"o_{c}") for c in ("region_id", "edge", "x", "y", "nx", "ny")), "row", "col")
    dx, dy, ox, oy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), F.col("o_nx") - F.col("o_x"), F.col("o_ny") - F.col("o_y")
    cross, length = dx * oy - dy * ox, F.sqrt(dx * dx + dy * dy)
    wx, wy = F.col("o_x") - F.col("x"), F.col("o_y") - F.col("y")
    t, u = (wx * oy - wy * ox) / F.nullif(cross, F.lit(0.0)), (wx * dy - wy * dx) / F.nullif(cross, F.lit(0.0))
    # ends of the other edge that lie on this one, which is all that parallel edges can share
    ends = [F.when(F.abs((F.col(f"o_{p}x") - F.col("x")) * dy - (F.col(f"o_{p}y") - F.col("y")) * dx) <= 1e-9 * length * length, ((F.col(f"o_{p}x") - F.col("x")) * dx + (F.col(f"o_{p}y") - F.col("y")) * dy) / (length * length)) for p in ("", "n")]
    found = F.array(F.when(u.between(0, 1), t), *ends)
    meets = cells.join(o, ["row", "col"]).where("region_id <> o_region_id").select("edge", F.explode(F.filter(found, lambda v: (v > 0) & (v < 1))).alias("t"))
    cuts = meets.groupBy("edge").agg(F.collect_set("t").alias("ts"))  # an edge's crossings with other rings
    at = F.array_sort(F.array_union(F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(0.0), F.lit(1.0))))
    parts = e.join(cuts, "edge", "left").withColumn("at", at).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("at") - 2)))
    on = lambda c, v: F.col(c) + v * (F.col(f"n{c}") - F.col(c))
    lo, hi = F.get("at", F.col("i")), F.get("at", F.col("i") + 1)
    parts = parts.select("edge", "i", on("x", lo).alias("x"), on("y", lo).alias("y"), on("x", hi).alias("nx"), on("y", hi).alias("ny"), ((on("x", lo) + on("x", hi)) / 2).alias("mx"), ((on("y", lo) + on("y", hi)) / 2).alias("my"), (dy / length).alias("ux"), (-dx / length).alias("uy"))
    parts = materialize(parts.where("ux is not null"))
    sides = parts.withColumn("side", F.explode(F.array(F.lit(-1e-3), F.lit(1e-3)))).select("edge", "i", "side", (F.col("mx") + F.col("side") * F.col("ux")).alias("px"), (F.col("my") + F.col("side") * F.col("uy")).alias("py"))
    held = _held_by(sides, index, cell, ["edge", "i", "side"]).select("edge", "i", "side").distinct()
    one = held.groupBy("edge", "i").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("edge", "i")
    return parts.join(one, ["edge", "i"], "left_semi").select("x", "y", "nx", "ny")


def within_region(cand: DataFrame, half_m: float, regions: DataFrame, cell: float = 10_000) -> DataFrame:
    """Candidates (cand_id, cx, cy) whose box of half side ``half_m`` lies in the union of the surveyed rings and meets no hole.

    ``regions``: (region_id, kind, k, x, y), one ring each; kind ``surveyed`` or ``not_flown``. The centre must lie in
    a surveyed ring and in no hole, and the box must meet neither the boundary of the union nor that of a hole. Cells are
    found to be inside, outside or on a boundary once, and all joins are on cells.
    """
    e = materialize(_edges(regions, ["region_id"]).select("region_id", "kind", "x", "y", "nx", "ny"))
    c = cand.select("cand_id", "cx", "cy")
    index = materialize(cell_index(e, cell), "cells")
    inside = _held_by(c.select("cand_id", F.col("cx").alias("px"), F.col("cy").alias("py")), index, cell, ["cand_id"])
    bounds = union_boundary(e.where("kind = 'surveyed'"), index.where("kind = 'surveyed'"), cell).unionByName(e.where("kind = 'not_flown'").select("x", "y", "nx", "ny"))
    box = c.withColumn("row", _cells(F.col("cy") - half_m, F.col("cy") + half_m, cell)).withColumn("col", _cells(F.col("cx") - half_m, F.col("cx") + half_m, cell))
    crossed = box.join(_passed(bounds, cell), ["row", "col"]).where(_touches(half_m)).select("cand_id")
    good = inside.where("kind = 'surveyed'").select("cand_id")
    return cand.join(good, "cand_id", "left_semi").join(inside.where("kind = 'not_flown'").select("cand_id").union(crossed), "cand_id", "left_anti")


def _struck(cand: DataFrame, other: DataFrame, reach: float, cell: float, hit: Callable) -> DataFrame:
    """Ids of candidates (cand_id, cx, cy) that one of ``other`` strikes: rows with xmin, ymin, xmax, ymax, and what ``hit`` needs.

    Others are dealt to all cells within ``reach``. In its cell a candidate goes through them, some at a time, until one
    strikes it, so that dense others cost no more pairs than it takes. ``hit(prepared, i, px, py)`` says whether others i strike
    points; ``hit.prepare(table)`` reads a cell's others.
    """
    kind, prepare = dict(cand.dtypes)["cand_id"], hit.prepare
    c = cand.where("cx is not null and cy is not null").select("cand_id", "cx", "cy", _cell(F.col("cx"), cell).alias("gx"), _cell(F.col("cy"), cell).alias("gy"))
    o = other.withColumn("gx", _cells(F.col("xmin") - reach - 1, F.col("xmax") + reach + 1, cell)).withColumn("gy", _cells(F.col("ymin") - reach - 1, F.col("ymax") + reach + 1, cell))

    def run(points: pa.Table, others: pa.Table) -> pa.Table:
        px, py = (points.column(c).to_numpy().astype(float) for c in ("cx", "cy"))
        x0, y0, x1, y1 = (others.column(c).to_numpy().astype(float) for c in ("xmin", "ymin", "xmax", "ymax"))
        alive, struck, at, ready = np.arange(len(px)), np.zeros(len(px), bool), 0, prepare(others)
        while len(alive) and at < len(x0):
            some = slice(at, at + max(1, min(64, 4_000_000 // len(alive))))
            at, ax, ay = some.stop, px[alive, None], py[alive, None]
            close = (x0[some] <= ax + reach) & (x1[some] >= ax - reach) & (y0[some] <= ay + reach) & (y1[some] >= ay - reach)
            p, i = np.nonzero(close)
            who = alive[p]
            struck[who[hit(ready, i + some.start, px[who], py[who])]] = True
            alive = alive[~struck[alive]]
        return pa.table({"cand_id": points.column("cand_id").filter(pa.array(struck))})

    return c.groupBy("gx", "gy").cogroup(o.groupBy("gx", "gy")).applyInArrow(run, f"cand_id {kind}")


class _Rings:
    """Whether rings (xs, ys) meet the box of half side ``r`` around points: an edge is cut by it, or the ring holds the point."""

    def __init__(self, r: float):
        self.r = r

    def prepare(self, table: pa.Table) -> tuple[np.ndarray, ...]:
        n = pc.list_value_length(table.column("xs")).to_numpy().astype(np.int64)
        x, y = (pc.list_flatten(table.column(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("xs", "ys"))
        first = np.cumsum(n) - n
        after = np.arange(1, len(x) + 1)
        after[first + n - 1] = first
        return first, n, x, y, x[after], y[after]

    def __call__(self, ready: tuple[np.ndarray, ...], i: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        first, n, *ends = ready
        size = n[i]
        if not len(i):
            return np.zeros(0, bool)
        begin = np.cumsum(size) - size
        edge = np.arange(size.sum()) + np.repeat(first[i] - begin, size)
        x, y, nx, ny = (e[edge] for e in ends)
        px, py = np.repeat(px, size), np.repeat(py, size)
        t0, t1, ok = np.zeros(len(edge)), np.ones(len(edge)), np.ones(len(edge), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            for d, p, mid in ((nx - x, x, px), (ny - y, y, py)):  # Liang-Barsky, as in _touches
                a, b = (mid - self.r - p) / d, (mid + self.r - p) / d
                moves = d != 0
                t0, t1 = np.where(moves, np.maximum(t0, np.minimum(a, b)), t0), np.where(moves, np.minimum(t1, np.maximum(a, b)), t1)
                ok &= moves | (np.abs(p - mid) <= self.r)
            spans = ((y <= py) & (py < ny)) | ((ny <= py) & (py < y))
            right = spans & (x + (py - y) * (nx - x) / (ny - y) > px)
        return np.logical_or.reduceat(ok & (t0 <= t1), begin) | (np.add.reduceat(right.astype(np.int64), begin) % 2 == 1)


class _Close:
    """Whether centres (xmin, ymin) are closer to points than ``d``."""

    def __init__(self, d: float):
        self.d = d

    def prepare(self, table: pa.Table) -> tuple[np.ndarray, ...]:
        return tuple(table.column(c).to_numpy().astype(float) for c in ("xmin", "ymin"))

    def __call__(self, ready: tuple[np.ndarray, ...], i: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        dx, dy = px - ready[0][i], py - ready[1][i]
        return dx * dx + dy * dy < self.d * self.d


def clear_of_features(cand: DataFrame, half_m: float, vert: DataFrame, buffer_m: float = 150, cell: float = 4_000, id_: str = "poly_id") -> DataFrame:
    """Candidates whose box of half side half_m + buffer_m meets no feature, given as vertices (poly_id, k, x, y) of one ring each.

    Features whose own box is close are found by cells; of these, one meets the box if an edge does or the centre lies
    inside. A feature of one vertex is a point.
    """
    r = half_m + buffer_m
    f = vert.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    f = f.where("xmin is not null and ymin is not null").select("xmin", "ymin", "xmax", "ymax", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
    return cand.join(_struck(cand, f, r, cell, _Rings(r)), "cand_id", "left_anti")


def _near(a: DataFrame, b: DataFrame, d: float) -> DataFrame:
    """Pairs of ``a`` (cand_id, cx, cy) and ``b`` (id, x, y) closer than ``d``: b is dealt to its 3 x 3 cells."""
    three = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    left = a.select("cand_id", "cx", "cy", F.floor(F.col("cx") / d).alias("gx"), F.floor(F.col("cy") / d).alias("gy"))
    right = b.withColumn("i", three).withColumn("j", three).withColumns({"gx": F.floor(F.col("x") / d) + F.col("i"), "gy": F.floor(F.col("y") / d) + F.col("j")}).drop("i", "j")
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    return left.join(right, ["gx", "gy"]).where(dx * dx + dy * dy < d * d)


def min_spacing_to(cand: DataFrame, centres: DataFrame, d: float = 800) -> DataFrame:
    """Candidates at least ``d`` from every centre (x, y)."""
    o = centres.where("x is not null and y is not null").select(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    return cand.join(_struck(cand, o, d, 5.0 * d, _Close(d)), "cand_id", "left_anti")


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a block in order, each with its earlier neighbours that are undecided: who stays, who goes, and who waits for another block."""
    state: dict = {}
    for c, near in zip(pdf["cand_id"].tolist(), pdf["near"].tolist(), strict=True):
        found = [state.get(o, "wait") for o in near]
        state[c] = "out" if "keep" in found else "wait" if "wait" in found else "keep"
    return pd.DataFrame({"cand_id": list(state), "state": list(state.values())})


def spaced_sample(cand: DataFrame, d: float = 800, priority: str = "cand_id", n: int | None = None, first: int = 4096) -> DataFrame:
    """Greedy thinning by ``priority``: a candidate stays if no one kept before lies within ``d``; then the first ``n``.

    Candidates go in order, ``first`` of them, then eight times as many, and so on: those close to one that was kept drop
    out before any pairs are made, so that dense candidates, which soon cover the ground, have few pairs left. The
    result is that of going through all of them one by one. Ids are unique; candidates without a place stay out.
    """
    c = cand.where("cx is not null and cy is not null").select("cand_id", "cx", "cy", F.col(priority).alias("__first"))
    c = materialize(row_numbers(c, ["__first", "cand_id"], "__rn"))
    total, at, size, parts = c.count(), 0, first, []
    while at < total:
        some = c.where(F.col("__rn").between(at + 1, at + size)).drop("__rn")
        if parts:
            kept = reduce(DataFrame.unionByName, parts).select(F.col("cx").alias("x"), F.col("cy").alias("y"))
            some = some.join(_near(some, kept, d).select("cand_id").distinct(), "cand_id", "left_anti")
        parts.append(_thinned(materialize(some), d))
        at, size = at + size, size * 8
    kept = cand.join(reduce(DataFrame.unionByName, parts).select("cand_id") if parts else cand.select("cand_id").limit(0), "cand_id", "left_semi")
    return kept.orderBy(priority, "cand_id").limit(n) if n is not None else kept


def _thinned(c: DataFrame, d: float) -> DataFrame:
    """What stays of written candidates (cand_id, cx, cy, __first), with its place.

    Close pairs are joined once. In each round every block of ``BLOCK`` distances goes through its undecided candidates
    in order, as far as they don't hang on another block's; what stays puts its later neighbours out everywhere. So a
    chain of close candidates takes as many rounds as it crosses blocks.
    """
    order, side = F.struct(F.col("__first").alias("p"), F.col("cand_id").alias("id")), BLOCK * d
    own = c.withColumn("__o", order)
    other = own.select(F.col("cand_id").alias("other"), F.col("__o").alias("__p"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    pairs = _near(c, other, d).join(own.select("cand_id", "__o"), "cand_id").where(F.col("__p") < F.col("__o")).select("cand_id", "other")
    pairs, undecided, parts, rounds = materialize(pairs), c, [], 0
    kind = dict(c.dtypes)["cand_id"]
    while not undecided.isEmpty():
        rounds += 1
        near = pairs.groupBy("cand_id").agg(F.collect_list("other").alias("near"))  # neighbours within d
        rows = undecided.join(near, "cand_id", "left").withColumn("near", F.coalesce("near", F.array().cast(f"array<{kind}>")))
        rows = rows.withColumns({"bx": F.floor(F.col("cx") / side), "by": F.floor(F.col("cy") / side)})
        told = materialize(rows.groupBy("bx", "by").applyInPandas(lambda pdf: _settled(pdf.sort_values(["__first", "cand_id"], na_position="first")), f"cand_id {kind}, state string"), "told")
        keep = told.where("state = 'keep'").select("cand_id")
        parts.append(keep)
        out = pairs.join(keep.withColumnRenamed("cand_id", "other"), "other", "left_semi").select("cand_id")
        gone = out.unionByName(told.where("state <> 'wait'").select("cand_id")).distinct()
        undecided = materialize(undecided.join(gone, "cand_id", "left_anti"))
        live = undecided.select("cand_id")
        pairs = materialize(pairs.join(live, "cand_id", "left_semi").join(live.withColumnRenamed("cand_id", "other"), "other", "left_semi"))
    logging.getLogger("standmap").info("spaced_sample: %d rounds", rounds)
    return materialize(c.join(reduce(DataFrame.unionByName, parts), "cand_id", "left_semi").select("cand_id", "cx", "cy")) if parts else c.select("cand_id", "cx", "cy")


def confirmed_negatives(
    cand: DataFrame, regions: DataFrame, vert: DataFrame, centres: DataFrame, present: DataFrame, window_m: float = 300, n: int | None = None, d: float = 800, spacing: float | None = None
) -> DataFrame:
    """Candidates inside the survey, clear of features, ``d`` from tiles and ``spacing`` (``d``) from each other, with imagery; as index rows."""
    half = window_m / 2
    ok = min_spacing_to(clear_of_features(within_region(cand, half, regions), half, vert), centres, d)
    out = spaced_sample(ok.join(present.select("cand_id"), "cand_id", "left_semi"), d if spacing is None else spacing, "cand_id", n)
    box = {"xmin": F.col("cx") - half, "ymin": F.col("cy") - half, "xmax": F.col("cx") + half, "ymax": F.col("cy") + half}
    return out.withColumns({**box, "role": F.lit("negative"), "window_m": F.lit(float(window_m))})


#: Vertices whose pairs go through numpy together, and pieces of edges that are held against each other at a time.
VERTICES, PIECES = 1 << 15, 1 << 20


def _columns(pair: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, turn: np.ndarray, x0: np.ndarray, wide: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges cut at the borders of their pair's ``n`` columns: (column, pair, x, y, slope, sign, lo, hi), upright ones left out."""
    use = (x < nx) | (x > nx)
    pair, x, y, nx, ny, turn = (v[use] for v in (pair, x, y, nx, ny, turn))
    lo, hi = np.minimum(x, nx), np.maximum(x, nx)
    at = lambda v: np.clip(np.floor((v - x0[pair]) / wide[pair] * n[pair]).astype(np.int64), 0, n[pair] - 1)
    first = at(lo)
    times = at(hi) - first + 1
    of = np.repeat(np.arange(len(x)), times)
    p = pair[of]
    i = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + first[of]
    cut = lambda i: x0[p] + i * wide[p] / n[p]
    lo, hi = np.maximum(lo[of], cut(i)), np.where(i == n[p] - 1, hi[of], np.minimum(hi[of], cut(i + 1)))
    slope, sign = (ny - y) / (nx - x), turn * np.sign(x - nx)
    return (np.cumsum(n) - n)[p] + i, p, x[of], y[of], slope[of], sign[of], lo, hi


def shared_area(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], pairs: int) -> np.ndarray:
    """The exact areas that pairs of simple polygons share, of their edges (pair, x, y, nx, ny, turn), all of a pair's coordinates known.

    A polygon is the signed sum of the trapezoids below its edges, and two trapezoids share what lies below the lower
    edge over their common span. Edges meet within columns of the pair's width, one for eight vertices, so that an edge
    meets those above and below it and not all others.
    """
    x0, base, x1, out = np.full(pairs, np.inf), np.full(pairs, np.inf), np.full(pairs, -np.inf), np.zeros(pairs)
    for pair, x, y, *_ in (a, b):
        np.minimum.at(x0, pair, x)
        np.minimum.at(base, pair, y)
        np.maximum.at(x1, pair, x)
    n = np.maximum(1, (np.bincount(a[0], minlength=pairs) + np.bincount(b[0], minlength=pairs)) // 8)
    ca, cb = (_columns(p, x, y - base[p], nx, ny - base[p], turn, x0, x1 - x0, n) for p, x, y, nx, ny, turn in (a, b))
    order = np.argsort(cb[0], kind="stable")
    cb = tuple(v[order] for v in cb)
    begin = np.searchsorted(cb[0], ca[0], "left")
    times = np.searchsorted(cb[0], ca[0], "right") - begin
    ends, at = np.cumsum(times), 0
    while at < len(times):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIECES, "right")))
        i = np.repeat(np.arange(at, to), times[at:to])
        j = np.arange(len(i)) - np.repeat(ends[at:to] - times[at:to] - done, times[at:to]) + begin[i]
        at = to
        u, v = np.maximum(ca[6][i], cb[6][j]), np.minimum(ca[7][i], cb[7][j])
        meet = u < v
        i, j, u, v = i[meet], j[meet], u[meet], v[meet]
        line = lambda e, k, w: e[3][k] + (w - e[2][k]) * e[4][k]
        au, av, bu, bv = line(ca, i, u), line(ca, i, v), line(cb, j, u), line(cb, j, v)
        du, dv = au - bu, av - bv
        t = np.divide(du, du - dv, out=np.ones_like(du), where=du * dv < 0)  # where the lines cross, as a share of the span
        mid = np.minimum(au + t * (av - au), bu + t * (bv - bu))
        below = (v - u) / 2 * (t * (np.minimum(au, bu) + mid) + (1 - t) * (mid + np.minimum(av, bv)))
        out += np.bincount(ca[1][i], ca[5][i] * cb[5][j] * below, pairs)
    return out


def _overlaps(table: pa.Table, id_: str) -> pa.Table:
    """The rows of :func:`polygon_overlap` of whole pairs (id, part, k, x, y), sorted."""
    first = np.flatnonzero(new_groups(table, [id_, "part"]))
    x, y = (table.column(c).to_numpy().astype(float) for c in ("x", "y"))
    size = np.diff(first, append=len(x))
    ring, after = np.repeat(np.arange(len(first)), size), np.arange(len(x)) + 1
    after[first + size - 1] = first
    # centroids relative to the first vertex, so that large coordinates lose no digits
    ax, ay = x - x[first][ring], y - y[first][ring]
    bx, by = ax[after], ay[after]
    cross = ax * by - bx * ay
    known = ~np.isnan(cross)
    s, sx, sy = (np.add.reduceat(np.where(known, v, 0.0), first) for v in (cross, (ax + bx) * cross, (ay + by) * cross))
    second = table.column("part").to_numpy(zero_copy_only=False)[first]
    same = ~new_groups(table, [id_])[first[1:]]
    a = np.flatnonzero(same & ~second[:-1] & second[1:] & (s[:-1] != 0) & (s[1:] != 0))
    b, area = a + 1, np.abs(s) / 2
    mx, my = (v[first] + np.divide(w, 3 * s, out=np.zeros_like(s), where=s != 0) for v, w in ((x, sx), (y, sy)))
    pair = np.full(len(first), -1)
    pair[a] = pair[b] = np.arange(len(a))
    rows = [np.flatnonzero(known & np.isin(ring, rings)) for rings in (a, b)]
    own = [pair[ring[r]] for r in rows]
    # all three relative to a's centroid
    moved = {"raw": (mx[a], my[a], np.ones(len(a))), "shift": (mx[b], my[b], np.ones(len(a))), "scaled": (mx[b], my[b], np.sqrt(area[a] / area[b]))}
    shared = {}
    for how, (ux, uy, f) in moved.items():
        sides = []
        for r, p, (cx, cy, g) in zip(rows, own, ((mx[a], my[a], np.ones(len(a))), (ux, uy, f)), strict=True):
            sides.append((p, (x[r] - cx[p]) * g[p], (y[r] - cy[p]) * g[p], (x[after[r]] - cx[p]) * g[p], (y[after[r]] - cy[p]) * g[p], np.sign(s[ring[r]])))
        shared[how] = shared_area(*sides, len(a))
    iou = [shared[h] / (area[a] + area[o] - shared[h]) for h, o in (("raw", b), ("shift", b), ("scaled", a))]
    dx, dy = mx[a] - mx[b], my[a] - my[b]
    out = [*iou, np.sqrt(dx * dx + dy * dy), area[b] / area[a]]
    return pa.Table.from_arrays([table.column(id_).take(pa.array(first[a])), *map(pa.array, out)], [id_, *FIGURES])


FIGURES = ("iou_raw", "iou_shift", "iou_scaled", "shift_m", "area_ratio")


def polygon_overlap(vert_a: DataFrame, vert_b: DataFrame, id_: str = "poly_id") -> DataFrame:
    """(id, iou_raw, iou_shift, iou_scaled, shift_m, area_ratio) of pairs of simple polygons, exact but for rounding.

    Shifted: b's centroid moved onto a's; scaled: and b resized to a's area. The ratio is b's area to a's. Polygons may
    turn either way; pairs that only one side has, that have no id, or of which one has no area, have no row. Vertices
    are shuffled once, by pair, and many pairs go through numpy together.
    """
    side = lambda v, second: v.where(F.col(id_).isNotNull()).select(id_, F.lit(second).alias("part"), "k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    both = dealt(side(vert_a, False).unionByName(side(vert_b, True)), id_).sortWithinPartitions(id_, "part", "k")

    def each(batches):
        for table in whole(batches, [id_], VERTICES):
            yield from _overlaps(table, id_).to_batches()

    return both.mapInArrow(each, f"{id_} {dict(both.dtypes)[id_]}, " + ", ".join(f"{c} double" for c in FIGURES))


def overlap_medians(pairs: DataFrame) -> DataFrame:
    """One row: the medians over pairs of each figure of :func:`polygon_overlap`."""
    pairs, out = materialize(pairs), None
    for c in ("shift_m", "area_ratio", "iou_raw", "iou_shift", "iou_scaled"):
        one = quantiles(pairs, c, [0.5]).select(F.get("q", F.lit(0)).alias(c))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def pair_shift_stats(pairs: DataFrame, by: str, shift: str = "shift_m") -> DataFrame:
    s = F.col(shift)
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_pop(s).alias("std"))
