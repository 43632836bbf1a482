"""Queries of the raster operators. Heavy ones look at all tiles in Spark and in SQL alike."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from standmap.operators import annotate, raster
from standmap.plans.registry import query
from standmap.plans.tables import RINGS
from standmap.sources.fixtures import Views

R = lambda c, n=6: F.round(c, n)
HOT = "prob > 0.5"


def digest(df, flag: str):
    """Per tile: how many pixels a mask has, and the sum of their places."""
    on = F.col(flag)
    return df.groupBy("tile_id").agg(F.count_if(on).alias("n"), F.sum(F.when(on, F.col("y") * 16 + F.col("x")).otherwise(0)).cast("long").alias("places"))


def sql_digest(source: str, flag: str) -> str:
    return f"SELECT tile_id, count(*) FILTER ({flag}) AS n, CAST(sum(CASE WHEN {flag} THEN y*16 + x ELSE 0 END) AS BIGINT) AS places FROM {source} GROUP BY tile_id"


# --- polygons --------------------------------------------------------------------------------------------------

SPANS = """edges AS (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY id ORDER BY k)),
px AS (SELECT id, i.y, j.x FROM edges e, (SELECT range AS y FROM range({n})) i, (SELECT range AS x FROM range({n})) j WHERE ((e.y <= i.y + 0.5 AND i.y + 0.5 < e.ny) OR (e.ny <= i.y + 0.5 AND i.y + 0.5 < e.y)) AND e.x + (i.y + 0.5 - e.y) * (e.nx - e.x) / (e.ny - e.y) <= j.x + 0.5 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query("poly vert", "WITH v AS (SELECT poly_id AS id, k, (x - cx + 500) / 40 AS x, (cy + 500 - y) / 40 AS y FROM vert JOIN poly USING (poly_id)), " + SPANS.format(n=25) + " SELECT id AS tile_id, count(*) AS n, CAST(sum(y*25 + x) AS BIGINT) AS places FROM px GROUP BY id")
def rasterize(v: Views):
    t = v.vert.join(v.poly.select("poly_id", "cx", "cy"), "poly_id").selectExpr("poly_id as tile_id", "k", "(x - cx + 500) / 40 as x", "(cy + 500 - y) / 40 as y")
    return raster.rasterize(t, 25, 25).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 25 + F.col("x")).cast("long").alias("places"))


@query()
def shapes_to_masks(v: Views):
    s = annotate.shape_table(v.annotations.repartition("ann_id")).withColumnRenamed("ann_id", "shape_id")  # few large files are no few tasks of rings
    return raster.shapes_to_masks(s, 16, 16).groupBy("tile_id").agg(F.count_if("damage").alias("damage"), F.count_if("ignore").alias("ignored"))


# --- crops -----------------------------------------------------------------------------------------------------

GRID = """g0 AS (SELECT tile_id, role, least(16, CAST(round_even(240.0::DOUBLE / (window_m / 16), 0) AS INT)) AS full_px FROM tiles),
g1 AS (SELECT *, greatest(1, CAST(round_even(full_px * CASE WHEN role = 'damage' THEN 0.5 ELSE 1.0 END, 0) AS INT)) AS step FROM g0),
g2 AS (SELECT *, CASE WHEN (16 - full_px) % step = 0 THEN range(0, 16 - full_px + 1, step) ELSE list_append(range(0, 16 - full_px + 1, step), 16 - full_px) END AS o FROM g1),
g3 AS (SELECT tile_id, role, full_px, o, unnest(o) AS y0, generate_subscripts(o, 1) - 1 AS crop_row FROM g2),
grid AS (SELECT tile_id, role, full_px, y0, crop_row, unnest(o) AS x0, generate_subscripts(o, 1) - 1 AS crop_col, concat_ws('_', tile_id, crop_row, generate_subscripts(o, 1) - 1) AS crop_id FROM g3)"""


def _grid(v: Views):
    return raster.crop_grid(v.tiles.withColumn("size_px", F.lit(16)), gsd=0.6, crop=400)


@query("tiles", f"WITH {GRID} SELECT tile_id, role, crop_row, crop_col, y0, x0, full_px, crop_id FROM grid")
def crop_grid(v: Views):
    return _grid(v).drop("step", "last")


LABELS = GRID + """, n AS (SELECT crop_id, count(*) AS n FROM grid JOIN pixels USING (tile_id) WHERE gt AND y >= y0 AND y < y0 + full_px AND x >= x0 AND x < x0 + full_px GROUP BY crop_id),
crops AS (SELECT grid.*, coalesce(n, 0) AS label_px, CASE WHEN coalesce(n, 0) >= 12 THEN 'damage' ELSE 'negative' END AS crop_role FROM grid LEFT JOIN n USING (crop_id)), kept AS (SELECT * FROM crops WHERE role <> 'damage' OR crop_role = 'damage')"""


@query("pixels", f"WITH {LABELS} SELECT crop_id, tile_id, label_px, crop_role FROM kept")
def crop_labels(v: Views):
    return raster.crop_labels(_grid(v), v.pixels, 12).select("crop_id", "tile_id", "label_px", "crop_role")


@query("pixels", f"WITH {LABELS} SELECT crop_id, count(*) AS n, CAST(sum(r * (y - y0 + 1)) AS BIGINT) AS r, CAST(sum(nir * (x - x0 + 1)) AS BIGINT) AS nir, count(*) FILTER (gt) AS gt FROM kept JOIN pixels USING (tile_id) WHERE y >= y0 AND y < y0 + full_px AND x >= x0 AND x < x0 + full_px GROUP BY crop_id")
def crop_pixels(v: Views):
    px = v.pixels
    out = raster.crop_pixels(raster.crop_labels(_grid(v), px, 12), px)
    # a crop is one tile's, and tiles are dealt out
    return out.groupBy("tile_id", "crop_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * (F.col("y") + 1)).cast("long").alias("r"), F.sum(F.col("nir") * (F.col("x") + 1)).cast("long").alias("nir"), F.count_if("gt").alias("gt")).drop("tile_id")


@query("pixels", f"WITH {LABELS} SELECT crop_role, count(*) AS n, count(DISTINCT tile_id) AS sources, round(min(window_m / 16), 6) AS gsd_min, round(median(window_m / 16), 6) AS gsd_median, round(max(window_m / 16), 6) AS gsd_max, CAST(sum(label_px) AS BIGINT) AS label_px FROM kept JOIN (SELECT tile_id, window_m FROM tiles) USING (tile_id) GROUP BY crop_role")
def crop_summary(v: Views):
    crops = raster.crop_labels(_grid(v), v.pixels, 12).join(v.tiles.selectExpr("tile_id", "window_m / 16 as gsd_m"), "tile_id")
    out = raster.crop_summary(crops)
    return out.withColumns({c: R(c) for c in ("gsd_min", "gsd_median", "gsd_max")})


@query("pixels", "SELECT tile_id, count(*) AS n, count(*) FILTER (gt) AS label_px, count(*) FILTER (ign AND NOT gt) AS ignore_px, round(count(*) FILTER (gt) / nullif(count(*) - count(*) FILTER (ign AND NOT gt), 0), 6) AS coverage FROM pixels GROUP BY tile_id")
def label_coverage(v: Views):
    return raster.label_coverage(v.pixels).withColumn("coverage", R("coverage"))


@query("pixels", "SELECT tile_id, 4 + tile_id % 30 AS label_size, count(*) FILTER (gt AND NOT (r=0 AND g=0 AND b=0)) AS counted, count(*) FILTER (r=0 AND g=0 AND b=0) AS nodata, 4 + tile_id % 30 = count(*) FILTER (gt AND NOT (r=0 AND g=0 AND b=0)) AS ok FROM pixels GROUP BY tile_id")
def label_size_check(v: Views):
    return raster.label_size_check(v.pixels, v.tiles.selectExpr("tile_id", "4 + tile_id % 30 as label_size"))


@query("pixels", "WITH m AS (SELECT range AS o, CAST(floor((range + 0.5) * 16 / 10.0::DOUBLE) AS INT) AS s FROM range(10)) SELECT tile_id, CAST(sum(r * (a.o + 1)) AS BIGINT) AS r, count(*) FILTER (gt) AS gt FROM pixels JOIN m a ON y = a.s JOIN m b ON x = b.s GROUP BY tile_id")
def resample_nearest(v: Views):
    return raster.resample_nearest(v.pixels, 10, 16, ["r", "gt"]).groupBy("tile_id").agg(F.sum(F.col("r") * (F.col("y") + 1)).cast("long").alias("r"), F.count_if("gt").alias("gt"))


@query("pixels", """WITH p AS (SELECT range AS o, (range + 0.5) * 16 / 10.0::DOUBLE - 0.5 AS p FROM range(10)), m AS (SELECT o, greatest(0, least(15, CAST(floor(p) AS INT))) AS s, 1 - (p - floor(p)) AS w FROM p UNION ALL SELECT o, greatest(0, least(15, CAST(floor(p) AS INT) + 1)), p - floor(p) FROM p),
t AS (SELECT tile_id, a.o AS y, b.o AS x, sum(r * a.w * b.w) AS r FROM pixels JOIN m a ON y = a.s JOIN m b ON x = b.s GROUP BY 1, 2, 3) SELECT tile_id, round(sum(r * (y + 1)), 4) AS r FROM t GROUP BY tile_id""")
def resample_bilinear(v: Views):
    return raster.resample_bilinear(v.pixels, 10, 16, ["r"]).groupBy("tile_id").agg(R(F.sum(F.col("r") * (F.col("y") + 1)), 4).alias("r"))


# --- windows ---------------------------------------------------------------------------------------------------


def _refl(k: int) -> str:
    """For each place 0-15, the places that its window of k reads, edges reflected."""
    rows = []
    for o in range(16):
        for i in range(-(k // 2), k - k // 2):
            s = o + i
            s = -1 - s if s < 0 else 31 - s if s > 15 else s
            if 0 <= s <= 15:
                rows.append((o, s))
    from collections import Counter

    return ", ".join(f"({o}, {s}, {n})" for (o, s), n in sorted(Counter(rows).items()))


def _box_sql(expr: str, k: int) -> str:
    """``boxed``: (tile_id, y, x, m, q): mean and mean square of an expression in a k x k window."""
    return f"""wk AS (SELECT * FROM (VALUES {_refl(k)}) AS t(o, s, n)),
b0 AS (SELECT tile_id, y, x, CAST({expr} AS DOUBLE) AS c FROM pixels),
b1 AS (SELECT tile_id, y, o AS x, sum(c * n) / sum(n) AS m, sum(c * c * n) / sum(n) AS q FROM b0 JOIN wk ON x = s GROUP BY 1, 2, 3),
boxed AS (SELECT tile_id, o AS y, x, sum(m * n) / sum(n) AS m, sum(q * n) / sum(n) AS q FROM b1 JOIN wk ON y = s GROUP BY 1, 2, 3)"""


@query("pixels", f"WITH {_box_sql('r', 5)} SELECT tile_id, CAST(sum(CAST(round(m * 25) AS BIGINT)) AS BIGINT) AS total, round(avg(sqrt(greatest(0.0, q - m*m))), 4) AS std FROM boxed GROUP BY tile_id")
def box_stats(v: Views):
    out = raster.box_stats(v.pixels.select("tile_id", "y", "x", "r"), "r", 5)
    # a window's sum is a whole number, so that no rounded mean hangs on the order of a sum
    return out.groupBy("tile_id").agg(F.sum(F.round(F.col("box_mean") * 25).cast("long")).alias("total"), R(F.avg("box_std"), 4).alias("std"))


CLIP = "least(1.0, greatest(0.0, {}))"
STRESS = f"""{_box_sql('(r + g + b)/3.0::DOUBLE', 31)},
s0 AS (SELECT p.*, least(0.6, greatest(0.0, ((r - g)/(r + g + 1.0::DOUBLE) + 1)/2 - 0.4))/0.6 AS brown, {CLIP.format('(0.2 - (nir - r)/(nir + r + 1.0::DOUBLE))/0.15')} AS boost, {CLIP.format('abs((r + g + b)/3.0::DOUBLE - m)/sqrt(greatest(1.0, q - m*m))/3')} AS odd FROM pixels p JOIN boxed USING (tile_id, y, x)),
st AS (SELECT *, 0.8*(0.7*brown + 0.3*boost) + 0.2*odd AS stress FROM s0)"""


@query("pixels", f"WITH {STRESS} SELECT tile_id, round(avg(stress), 5) AS stress FROM st GROUP BY tile_id")
def stress_map(v: Views):
    return raster.stress_map(v.pixels.select("tile_id", "y", "x", "r", "g", "b", "nir")).groupBy("tile_id").agg(R(F.avg("stress"), 5).alias("stress"))


GREEN = "CASE WHEN g / (r + g + b + 1.0::DOUBLE) > 0.33 THEN 1 ELSE 0 END"
GAP = _box_sql(GREEN, 15).replace("wk AS", "gk AS").replace("JOIN wk", "JOIN gk").replace("b0", "g0").replace("b1", "g1").replace("boxed", "greened")


@query("pixels", f"WITH {STRESS}, {GAP}, d AS (SELECT st.*, CASE WHEN prior THEN 0.0 ELSE {CLIP.format('greened.m')} END AS gap FROM st JOIN greened USING (tile_id, y, x)) SELECT tile_id, CAST(sum(CAST(round(gap * 225) AS BIGINT)) AS BIGINT) AS gap_px, round(avg(0.5*gap + 0.5*stress), 5) AS damage_map FROM d GROUP BY tile_id")
def gap_and_damage_map(v: Views):
    return raster.gap_and_damage_map(v.pixels.select("tile_id", "y", "x", "r", "g", "b", "nir", "prior"), "prior").groupBy("tile_id").agg(F.sum(F.round(F.col("gap") * 225).cast("long")).alias("gap_px"), R(F.avg("damage_map"), 5).alias("damage_map"))


CUT = "cut AS (SELECT tile_id, quantile_cont(prob, 0.65) AS c FROM pixels WHERE prior GROUP BY tile_id), sel AS (SELECT p.*, coalesce(prior AND prob > c AND prob > 0.1, false) AS selected FROM pixels p LEFT JOIN cut USING (tile_id))"


@query("pixels", f"WITH {CUT} " + sql_digest("sel", "selected"))
def percentile_mask(v: Views):
    return digest(raster.percentile_mask(v.pixels, "prob", 65, "prior", 0.1), "selected")


def _morph(source: str, into: str, op: str, element: str = "cross", k: int = 3, flag: str = "m") -> str:
    """One dilation or erosion of ``source`` (tile_id, y, x, m) as a CTE named ``into``; places outside are false."""
    cells = [(dy, dx) for dy in range(-(k // 2), k - k // 2) for dx in range(-(k // 2), k - k // 2)] if element == "square" else [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    values = ", ".join(f"({a}, {b})" for a, b in cells)
    agg = "bool_or(q.m)" if op == "dilate" else f"count(*) FILTER (q.m) = {len(cells)}"
    return f"{into} AS (SELECT p.tile_id, p.y, p.x, coalesce({agg}, false) AS m FROM {source} p CROSS JOIN (VALUES {values}) AS d(dy, dx) LEFT JOIN {source} q ON q.tile_id = p.tile_id AND q.y = p.y + d.dy AND q.x = p.x + d.dx GROUP BY 1, 2, 3)"


HOTMASK = "h AS (SELECT tile_id, y, x, prob > 0.5 AS m FROM pixels)"


@query("pixels", f"WITH {HOTMASK}, {_morph('h', 'e', 'erode')}, {_morph('e', 'o', 'dilate')}, {_morph('h', 'd', 'dilate', 'square', 4)}, a AS ({sql_digest('o', 'm')}), b AS ({sql_digest('d', 'm')}) SELECT tile_id, a.n AS opened, a.places AS opened_places, b.n AS dilated, b.places AS dilated_places FROM a JOIN b USING (tile_id)")
def morphology(v: Views):
    px = v.pixels.select("tile_id", "y", "x", F.expr(HOT).alias("m"))
    a = digest(raster.morphology(px, "m", "open"), "m").toDF("tile_id", "opened", "opened_places")
    return a.join(digest(raster.morphology(px, "m", "dilate", "square", k=4), "m").toDF("tile_id", "dilated", "dilated_places"), "tile_id")


@query("pixels", f"WITH h AS (SELECT tile_id, y, x, prior AS m FROM pixels), {_morph('h', 'e', 'erode')}, c AS (SELECT h.tile_id, h.y, h.x, h.m AND NOT e.m AS m FROM h JOIN e USING (tile_id, y, x)) " + sql_digest("c", "m"))
def mask_contour(v: Views):
    return digest(raster.mask_contour(v.pixels.select("tile_id", "y", "x", "prior"), "prior"), "contour")


def _blur_sql(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    w = [x / sum(w) for x in w]
    cell = {}
    for o in range(16):
        for i, x in enumerate(w):
            s = (o + i - r) % 32
            s = s if s < 16 else 31 - s
            cell[o, s] = cell.get((o, s), 0.0) + x
    return ", ".join(f"({o}, {s}, {x!r}::DOUBLE)" for (o, s), x in sorted(cell.items()))


@query("pixels", f"WITH w AS (SELECT * FROM (VALUES {_blur_sql(1.5)}) AS t(o, s, w)), a AS (SELECT tile_id, y, o AS x, sum(prob*w) AS p FROM pixels JOIN w ON x = s GROUP BY 1, 2, 3), b AS (SELECT tile_id, o AS y, x, sum(p*w) AS p FROM a JOIN w ON y = s GROUP BY 1, 2, 3) SELECT tile_id, round(sum(p*(y+1)), 5) AS sy, round(sum(p*p), 5) AS q FROM b GROUP BY tile_id")
def gaussian_blur(v: Views):
    out = raster.gaussian_blur(v.pixels.select("tile_id", "y", "x", "prob"), "prob", 1.5)
    return out.groupBy("tile_id").agg(R(F.sum(F.col("blur") * (F.col("y") + 1)), 5).alias("sy"), R(F.sum(F.col("blur") * F.col("blur")), 5).alias("q"))


DIST = "SELECT p.tile_id, p.y, p.x, sqrt(min((p.y-q.y)*(p.y-q.y) + (p.x-q.x)*(p.x-q.x))) AS d FROM pixels p JOIN pixels q ON p.tile_id = q.tile_id AND q.{} GROUP BY 1, 2, 3"


@query("pixels", f"WITH d AS ({DIST.format('gt')}) SELECT tile_id, round(sum(d), 5) AS s, round(max(d), 5) AS m FROM tiles LEFT JOIN d USING (tile_id) GROUP BY tile_id")
def distance_transform(v: Views):
    out = raster.distance_transform(v.pixels.select("tile_id", "y", "x", "gt"), "gt")
    return out.groupBy("tile_id").agg(R(F.sum("dist"), 5).alias("s"), R(F.max("dist"), 5).alias("m"))


@query("pixels", f"WITH i AS (SELECT tile_id, y, x, d FROM ({DIST.format('prior')})), n AS (SELECT p.tile_id, p.y, p.x, sqrt(min((p.y-q.y)*(p.y-q.y) + (p.x-q.x)*(p.x-q.x))) AS d FROM pixels p JOIN pixels q ON p.tile_id = q.tile_id AND NOT q.prior GROUP BY 1, 2, 3) SELECT tile_id, round(sum(CASE WHEN i.d IS NULL THEN 0.0 WHEN n.d IS NULL THEN 1.0 ELSE 0.5*(tanh((n.d - i.d)/16) + 1) END), 5) AS soft FROM pixels LEFT JOIN i USING (tile_id, y, x) LEFT JOIN n USING (tile_id, y, x) GROUP BY tile_id")
def soft_prior(v: Views):
    return raster.soft_prior(v.pixels.select("tile_id", "y", "x", "prior"), "prior").groupBy("tile_id").agg(R(F.sum("soft"), 5).alias("soft"))


@query()
def proximity_map(v: Views):
    return raster.proximity_map(v.pixels.select("tile_id", "y", "x", "prob"), "prob").groupBy("tile_id").agg(R(F.avg("proximity"), 5).alias("proximity"))


# --- blobs -----------------------------------------------------------------------------------------------------


def blobs_sql(flag: str, into: str = "blobs") -> str:
    """``into``: (tile_id, y, x, blob, blob_px) by a recursive walk from pixel to pixel, 4-connected; blob = min(y * 2^20 + x)."""
    return f"""on_ AS (SELECT tile_id, y, x, y*16 + x AS i FROM pixels WHERE {flag}),
runs AS (SELECT tile_id, y, x - rn AS g, min(x) AS x0, max(x) AS x1, min(y*16 + x) AS i FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, y ORDER BY x) AS rn FROM on_) GROUP BY 1, 2, 3),
adj AS (SELECT a.tile_id, a.i AS s, b.i AS t FROM runs a JOIN runs b ON a.tile_id = b.tile_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
walk AS (SELECT tile_id, i AS s, i AS t FROM runs UNION SELECT w.tile_id, w.s, a.t FROM walk w JOIN adj a ON w.tile_id = a.tile_id AND w.t = a.s),
lab AS (SELECT tile_id, t AS i, min(s) AS b FROM walk GROUP BY 1, 2),
lr AS (SELECT r.tile_id, r.y, r.x0, r.x1, (b // 16) * 1048576 + b % 16 AS blob FROM runs r JOIN lab l ON r.tile_id = l.tile_id AND r.i = l.i),
sz AS (SELECT tile_id, blob, CAST(sum(x1 - x0 + 1) AS BIGINT) AS blob_px FROM lr GROUP BY 1, 2),
{into} AS (SELECT tile_id, y, unnest(range(x0, x1 + 1)) AS x, blob, blob_px FROM lr JOIN sz USING (tile_id, blob))"""


@query("pixels", f"WITH RECURSIVE {blobs_sql('prob > 0.5')} SELECT tile_id, blob, blob_px, count(*) AS n FROM blobs GROUP BY 1, 2, 3")
def connected_components(v: Views):
    out = raster.connected_components(v.pixels.select("tile_id", "y", "x", F.expr(HOT).alias("m")), "m")
    return out.groupBy("tile_id", "blob", "blob_px").agg(F.count(F.lit(1)).alias("n"))


@query("pixels", f"WITH RECURSIVE {blobs_sql('prob > 0.5')}, k AS (SELECT p.tile_id, p.y, p.x, coalesce(blob_px >= 0.02 * 256, false) AS m FROM pixels p LEFT JOIN blobs USING (tile_id, y, x)) " + sql_digest("k", "m"))
def drop_small_blobs(v: Views):
    return digest(raster.drop_small_blobs(v.pixels.select("tile_id", "y", "x", F.expr(HOT).alias("m")), "m", 0.02), "m")


# corners of a blob: points around which one or three pixels are its own, and twice those where two meet at the point alone
OUTLINE = f"""{blobs_sql('prior')}, bp AS (SELECT tile_id, blob, blob_px, y, x FROM blobs),
sd AS (SELECT tile_id, blob, count(*) AS kin FROM bp a JOIN bp b USING (tile_id, blob) WHERE abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2),
pt AS (SELECT tile_id, blob, y + dy AS y, x + dx AS x, count(*) AS n, sum(2*dy + dx) AS s FROM bp, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dy, dx) GROUP BY 1, 2, 3, 4),
co AS (SELECT tile_id, blob, CAST(sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) AS BIGINT) AS corners FROM pt GROUP BY 1, 2),
bs AS (SELECT tile_id, blob, count(*) AS blob_px FROM bp GROUP BY 1, 2)"""


@query("pixels", f"WITH RECURSIVE {OUTLINE} SELECT tile_id, blob, blob_px, CAST(blob_px AS DOUBLE) AS area, 4*blob_px - coalesce(kin, 0) AS perimeter, corners FROM bs LEFT JOIN sd USING (tile_id, blob) JOIN co USING (tile_id, blob)")
def mask_to_polygons(v: Views):
    """Blobs of the prior have no holes, so that a ring's area is the blob's pixels."""
    out = raster.mask_to_polygons(v.pixels.select("tile_id", "y", "x", "prior"), "prior")
    p, n = F.col("points"), F.size("points")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, (i + 1) % n).alias("b")))
    over = lambda f: F.aggregate(ends, F.lit(0.0), lambda s, e: s + f(F.get(e["a"], F.lit(0)), F.get(e["a"], F.lit(1)), F.get(e["b"], F.lit(0)), F.get(e["b"], F.lit(1))))
    area = over(lambda ax, ay, bx, by: (ax * by - bx * ay) / 2)
    length = over(lambda ax, ay, bx, by: F.abs(ax - bx) + F.abs(ay - by))
    return out.select("tile_id", "blob", "blob_px", area.alias("area"), length.cast("long").alias("perimeter"), n.cast("long").alias("corners"))


@query()
def draft_regions(v: Views):
    return raster.draft_regions(v.pixels.select("tile_id", "y", "x", "prob", "prior"), "prob", "prior", opened=1, closed=1)


@query()
def weak_label(v: Views):
    out = raster.weak_label(v.pixels.select("tile_id", "y", "x", "prob"), "prob", shift=2)
    return out.groupBy("tile_id").agg(F.count_if("weak").alias("weak"), F.count_if("corrupt").alias("corrupt"))


@query("pixels", "SELECT tile_id, count(*) AS n, CAST(sum((y-2)*16 + x+3) AS BIGINT) AS places FROM pixels WHERE gt AND y-2 BETWEEN 0 AND 15 AND x+3 BETWEEN 0 AND 15 GROUP BY tile_id")
def shift_mask(v: Views):
    return digest(raster.shift_mask(v.pixels, "gt", 3, -2).withColumn("m", F.lit(True)), "m")


def _energies(moves: str, into: str) -> str:
    """``into``: (tile_id, dx, dy, e) of the shifts in ``moves``; 999 where too little is left of the mask or its contour."""
    side = lambda source, value: f"SELECT m.tile_id, m.dx, m.dy, count(q.y) AS n, avg(q.{value}) AS v FROM {moves} m JOIN {source} c ON c.tile_id = m.tile_id LEFT JOIN sig q ON q.tile_id = m.tile_id AND q.y = c.y + m.dy AND q.x = c.x + m.dx GROUP BY 1, 2, 3"
    return f"""{into} AS (SELECT i.tile_id, i.dx, i.dy, CASE WHEN i.n < greatest(10, 0.3*np) OR k.n < greatest(10, 0.3*nc) THEN 999.0 ELSE round(0.7*(mean - i.v) + 0.2*k.v/20 + 0.2*greatest(1 - i.n/np, 1 - k.n/nc), 9) END AS e
 FROM ({side('pt', 'prob')}) i JOIN ({side('con', 'near')}) k ON i.tile_id = k.tile_id AND i.dx = k.dx AND i.dy = k.dy JOIN ok ON ok.tile_id = i.tile_id)"""


# the distance to a boundary is beyond a short statement, so red stands in for it on both sides
ALIGN = f"""sig AS (SELECT tile_id, y, x, gt, prob, r/8.0::DOUBLE AS near FROM pixels), h AS (SELECT tile_id, y, x, gt AS m FROM pixels), {_morph('h', 'e', 'erode')},
pt AS (SELECT tile_id, y, x FROM pixels WHERE gt), con AS (SELECT h.tile_id, h.y, h.x FROM h JOIN e USING (tile_id, y, x) WHERE h.m AND NOT e.m),
al AS (SELECT tile_id, avg(prob) AS mean, count(*) FILTER (gt) AS np FROM pixels GROUP BY 1), ok AS (SELECT al.*, nc FROM al JOIN (SELECT tile_id, count(*) AS nc FROM con GROUP BY 1) USING (tile_id) WHERE np >= 50 AND nc >= 10),
mv1 AS (SELECT tile_id, a.range*3 - 6 AS dx, b.range*3 - 6 AS dy FROM ok, range(5) a, range(5) b), {_energies('mv1', 'e1')},
f1 AS (SELECT tile_id, CASE WHEN e < 999 THEN dx ELSE 0 END AS dx, CASE WHEN e < 999 THEN dy ELSE 0 END AS dy, e FROM e1 QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY e, dy, dx) = 1),
mv2 AS (SELECT tile_id, dx + a.range - 2 AS dx, dy + b.range - 2 AS dy FROM f1, range(5) a, range(5) b WHERE abs(dx + a.range - 2) <= 6 AND abs(dy + b.range - 2) <= 6), {_energies('mv2', 'e2')},
bst AS (SELECT tile_id, dx, dy, e FROM (SELECT *, 0 AS k FROM f1 UNION ALL SELECT *, 1 FROM e2) QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY e, k, dy, dx) = 1)"""


@query("pixels", f"WITH {ALIGN} SELECT al.tile_id, CAST(coalesce(dx, 0) AS INT) AS dx, CAST(coalesce(dy, 0) AS INT) AS dy, round(coalesce(e, 0.5), 6) AS energy, round(greatest(0.0, least(1.0, 0.5 - coalesce(e, 0.5))), 6) AS score FROM al LEFT JOIN bst USING (tile_id)")
def alignment_search(v: Views):
    px = v.pixels.select("tile_id", "y", "x", "gt", "prob", (F.col("r") / 8.0).alias("near"))
    out = raster.alignment_search(px, "gt", "prob", "near", radius=6, step=3, fine=2)
    return out.withColumns({"energy": R("energy"), "score": R("score")})


DULL = "NOT ((r/255.0::DOUBLE + g/255.0::DOUBLE + b/255.0::DOUBLE)/3 > 0.6 AND 2*(g/255.0::DOUBLE) - r/255.0::DOUBLE - b/255.0::DOUBLE < 0.1)"


@query("pixels", f"""WITH RECURSIVE h AS (SELECT tile_id, y, x, prob > 0.3 AND {DULL} AS m FROM pixels), {_morph('h', 'e', 'erode')}, {_morph('e', 'o', 'dilate')}, {blobs_sql('m').replace('FROM pixels WHERE m', 'FROM o WHERE m')},
j AS (SELECT p.*, (gt OR NOT ign) AS v, prob > 0.3 AS raw, h.m AS masked, coalesce(blob_px >= 0.01 * 256, false) AS clean FROM pixels p JOIN h USING (tile_id, y, x) LEFT JOIN blobs USING (tile_id, y, x)),
n AS (SELECT tile_id, count(*) AS n, count(*) FILTER (v AND gt) AS g, count(*) FILTER (v AND raw AND NOT masked) AS removed_px, {', '.join(f"count(*) FILTER (v AND {k} AND gt) AS i_{k}, count(*) FILTER (v AND ({k} OR gt)) AS u_{k}, count(*) FILTER ({k}) AS p_{k}" for k in ('raw', 'masked', 'clean'))} FROM j GROUP BY 1)
SELECT tile_id, {', '.join(f"round(CASE WHEN g > 0 THEN i_{k}/u_{k} END, 6) AS iou_{k}, round(CASE WHEN g > 0 THEN i_{k}/g END, 6) AS recall_{k}, round(CASE WHEN g = 0 THEN p_{k}/n END, 6) AS painted_{k}" for k in ('raw', 'masked', 'clean'))}, removed_px FROM n""")
def veg_mask_clean(v: Views):
    px = raster.veg_mask_clean(v.pixels.select("tile_id", "y", "x", "r", "g", "b", "gt", "ign", F.expr("prob > 0.3").alias("pred")), "pred", min_frac=0.01)
    out = raster.veg_mask_scores(px, "pred")
    return out.select(*((R(c).alias(c) if k == "double" else c) for c, k in out.dtypes))


@query("pixels", "WITH a AS (SELECT tile_id, y, x, g > r AND g > avg(g) OVER (PARTITION BY tile_id) AS m FROM pixels) " + sql_digest("a", "m"))
def green_channel_mask(v: Views):
    return digest(raster.green_channel_mask(v.pixels), "canopy")


# --- patches and views -----------------------------------------------------------------------------------------

PATCHES = """ts AS (SELECT tile_id, CAST(600 + tile_id % 500 AS INT) AS size_px FROM tiles), pr AS (SELECT tile_id, size_px, range AS i, range * 360 AS o FROM ts, range(4) WHERE range * 360 <= size_px - 1),
patches AS (SELECT a.tile_id, a.i AS patch_row, a.o AS y0, b.i AS patch_col, b.o AS x0, least(400, a.size_px - a.o) AS h, least(400, a.size_px - b.o) AS w, a.size_px FROM pr a JOIN pr b USING (tile_id) WHERE least(400, a.size_px - a.o) >= 100 AND least(400, a.size_px - b.o) >= 100)"""


def _sized(v: Views):
    return v.tiles.select("tile_id", (F.lit(600) + F.col("tile_id") % 500).cast("int").alias("size_px"))


@query("tiles", f"WITH {PATCHES} SELECT tile_id, patch_row, patch_col, y0, x0, h, w FROM patches")
def patch_grid(v: Views):
    return raster.patch_grid(_sized(v)).select("tile_id", "patch_row", "patch_col", "y0", "x0", "h", "w")


@query("tiles patch_boxes", f"WITH {PATCHES}, bx AS (SELECT b.tile_id, greatest(0, least(size_px, xmin + x0)) AS x0, greatest(0, least(size_px, xmax + x0)) AS x1, greatest(0, least(size_px, ymin + y0)) AS y0, greatest(0, least(size_px, ymax + y0)) AS y1 FROM patch_boxes b JOIN patches p USING (tile_id, patch_row, patch_col) WHERE score >= 0.3), ok AS (SELECT * FROM bx WHERE x0 < x1 AND y0 < y1), r AS (SELECT DISTINCT tile_id, unnest(range(y0, y1)) AS y, x0, x1 FROM ok), s AS (SELECT tile_id, greatest(0, x1 - greatest(x0, coalesce(max(x1) OVER (PARTITION BY tile_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM r), c AS (SELECT tile_id, CAST(sum(n) AS BIGINT) AS covered_px FROM s GROUP BY 1), k AS (SELECT tile_id, count(*) AS n_boxes FROM ok GROUP BY 1) SELECT tile_id, n_boxes, covered_px FROM k JOIN c USING (tile_id)")
def merge_patch_boxes(v: Views):
    # both sides come from a file that is small for its rows, by which Spark would broadcast one, patches included
    patches = raster.patch_grid(_sized(v)).join(_sized(v).hint("merge"), "tile_id").select("tile_id", "patch_row", "patch_col", "y0", "x0", "size_px")
    boxes = v.patch_boxes.select("tile_id", F.col("patch_row").cast("int").alias("patch_row"), F.col("patch_col").cast("int").alias("patch_col"), *(F.col(c).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), "score")
    return raster.box_coverage(raster.merge_patch_boxes(boxes, patches))


def _views(v: Views):
    """Eight dihedral views of each tile in their own coordinates, each with an offset of view / 1024."""
    px = v.pixels.select("tile_id", "y", "x", "prob").withColumn("turns", F.explode(F.array(*map(F.lit, range(4))))).withColumn("flip", F.explode(F.array(F.lit(False), F.lit(True))))
    y, x, t = F.col("y"), F.col("x"), F.col("turns")
    vy = F.when(t == 0, y).when(t == 1, 15 - x).when(t == 2, 15 - y).otherwise(x)
    vx = F.when(t == 0, x).when(t == 1, y).when(t == 2, 15 - x).otherwise(15 - y)
    return px.select("tile_id", "turns", "flip", vy.alias("y"), F.when(F.col("flip"), 15 - vx).otherwise(vx).alias("x"), (F.col("prob") + (t * 2 + F.col("flip").cast("int")) / 1024).alias("prob"))


@query("pixels", "SELECT tile_id, round(sum((prob + 3.5/1024)*(y*16 + x)), 5) AS s, count(*) AS n FROM pixels GROUP BY tile_id")
def tta_average(v: Views):
    return raster.tta_average(_views(v)).groupBy("tile_id").agg(R(F.sum(F.col("prob") * (F.col("y") * 16 + F.col("x"))), 5).alias("s"), F.count(F.lit(1)).alias("n"))
