"""Queries of the tabular operators: sources and sinks, scalars, filters, joins, ordering, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from standmap.functions import geometry as geo
from standmap.functions import spectral as sp
from standmap.operators import annotate, select, spatial
from standmap.operators.evaluate import iou_dice
from standmap.plans.registry import query
from standmap.sources import io
from standmap.sources.fixtures import Views
from standmap.sources.store import materialize, scratch

R = lambda c, n=6: F.round(c, n)
SEVERITY = "CASE pct_affected WHEN 'Very Severe (>50%)' THEN 0 WHEN 'Severe (30-50%)' THEN 1 WHEN 'Moderate (11-29%)' THEN 2 WHEN 'Light (4-10%)' THEN 3 WHEN 'Very Light (1-3%)' THEN 4 ELSE 9 END"
RAND = "(({id}*7919 + 42*104729) % 1000003)"


# --- sources and sinks -----------------------------------------------------------------------------------------


@query("poly", "SELECT btrim(observation_id, '{}') AS observation_id, poly_id, cx, cy, dca FROM poly".replace("btrim", "trim"))
def read_features(v: Views):
    path = scratch(v.spark)
    v.poly.write.json(path)
    schema = "observation_id string, poly_id long, cx double, cy double, dca string"
    return io.read_features(v.spark, path, schema)


@query("tiles", "SELECT CASE WHEN length(cast(tile_id AS varchar)) < 4 THEN lpad(cast(tile_id AS varchar), 4, '0') ELSE cast(tile_id AS varchar) END AS tile_id, 'damage' AS role, window_m, region_id, dca, source_id FROM tiles WHERE role = 'damage' UNION ALL SELECT CASE WHEN length(cast(tile_id AS varchar)) < 4 THEN lpad(cast(tile_id AS varchar), 4, '0') ELSE cast(tile_id AS varchar) END, role, window_m, region_id, dca, source_id FROM tiles WHERE role <> 'damage'")
def read_tile_index(v: Views):
    path = scratch(v.spark)
    v.tiles.withColumn("role", F.when(F.col("role") != "damage", F.col("role"))).write.option("header", True).csv(path)
    return io.read_tile_index(v.spark, path).select("tile_id", "role", "window_m", "region_id", "dca", "source_id")


POINTS_SQL = "CAST(points_json AS DOUBLE[][])"


def _documents(v: Views):
    shapes = v.annotations.where("version = '6.3.1'").select("tile_id", F.col("ann_id").alias("shape_no"), "label", F.from_json("points_json", annotate.POINTS).alias("points"), F.lit(16).alias("height"), F.lit(16).alias("width"))
    return shapes


@query("annotations", f"WITH a AS (SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY ann_id) - 1 AS shape_no, label, {POINTS_SQL} AS p FROM annotations WHERE version = '6.3.1') SELECT CASE WHEN length(cast(tile_id AS varchar)) < 4 THEN lpad(cast(tile_id AS varchar), 4, '0') ELSE cast(tile_id AS varchar) END AS tile_id, shape_no, label, len(p) AS n_points, p[1][1] AS x0, p[1][2] AS y0 FROM a")
def read_annotations(v: Views):
    path = scratch(v.spark)
    io.write_draft_annotations(_documents(v), None, path)
    out = io.read_annotations(v.spark, path)
    return out.select("tile_id", "shape_no", "label", F.size("points").alias("n_points"), F.expr("points[0][0]").alias("x0"), F.expr("points[0][1]").alias("y0"))


@query("annotations", "SELECT tile_id, ann_id, version FROM annotations QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY CASE version WHEN '6.3.1' THEN 1 WHEN '5.5.0' THEN 2 ELSE 3 END, ann_id) = 1")
def annotation_precedence(v: Views):
    return annotate.annotation_precedence(v.annotations, "version", ["6.3.1", "5.5.0"]).select("tile_id", "ann_id", "version")


@query("annotations", "SELECT tile_id, count(*) AS n_shapes, '5.5.0' AS version FROM annotations WHERE version = '6.3.1' AND tile_id NOT IN (SELECT tile_id FROM annotations WHERE label = 'reject') GROUP BY tile_id")
def write_draft_annotations(v: Views):
    path = scratch(v.spark)
    io.write_draft_annotations(_documents(v), v.annotations.where("label = 'reject'"), path)
    return io.read_annotations(v.spark, path).groupBy(F.col("tile_id").cast("long").alias("tile_id")).agg(F.count(F.lit(1)).alias("n_shapes"), F.max("version").alias("version"))


@query("tiles", "WITH p AS (SELECT tile_id, role, dca FROM tiles WHERE role = 'damage') SELECT tile_id, role, dca FROM p UNION ALL SELECT (SELECT max(tile_id) FROM p) + row_number() OVER (ORDER BY lat, tile_id), role, NULL FROM tiles WHERE role = 'negative'")
def append_index(v: Views):
    t = v.tiles
    new = t.where("role = 'negative'").select("tile_id", "role", "lat", F.col("tile_id").alias("was"))
    return io.append_index(t.where("role = 'damage'").select("tile_id", "role", "dca"), new, ["lat", "was"]).select("tile_id", "role", "dca")


@query("pixels", """WITH c AS (SELECT tile_id, tile_id % 5 AS fold, count(*) FILTER ((gt OR NOT ign) AND gt AND prob > (tile_id % 5 + 2)/10.0::DOUBLE) AS i, count(*) FILTER ((gt OR NOT ign) AND (gt OR prob > (tile_id % 5 + 2)/10.0::DOUBLE)) AS u, count(*) FILTER (gt) AS g,
 count(*) FILTER ((gt OR NOT ign) AND prob > (tile_id % 5 + 2)/10.0::DOUBLE) AS p, count(*) AS n, CAST(sum(CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, prob*1.2::DOUBLE - 0.1::DOUBLE))*255) AS BIGINT)) AS BIGINT) AS q FROM pixels GROUP BY 1, 2)
SELECT fold, tile_id, n, q, round(CASE WHEN g > 0 THEN i/u END, 6) AS iou, round(CASE WHEN g > 0 THEN 2*i/(p+g) END, 6) AS dice, (fold + 2)/10.0::DOUBLE AS threshold FROM c""")
def prediction_checkpoint(v: Views):
    """Each fold is written by itself, as it is predicted; what a reader gets back is quantised pixels and the tiles' scores."""
    path, fold = scratch(v.spark), (F.col("tile_id") % 5).alias("fold")
    px = v.pixels.select("*", fold, ((F.col("tile_id") % 5 + 2) / 10).alias("threshold"))
    scores = iou_dice(px, F.col("prob") > F.col("threshold")).select("*", fold, ((F.col("tile_id") % 5 + 2) / 10).alias("threshold"))
    folds = v.spark.range(5).select(F.col("id").alias("fold"))
    for r in io.unfinished_folds(folds, path).orderBy("fold").toLocalIterator():  # a row per fold
        one = px.where(F.col("fold") == r.fold).select("tile_id", "fold", "y", "x", (F.col("prob") * 1.2 - 0.1).alias("prob"))
        io.prediction_checkpoint(one, scores.where(F.col("fold") == r.fold), path)
    pixels, kept = io.read_checkpoint(v.spark, path)
    q = pixels.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("q"))
    return kept.join(q, "tile_id").select("fold", "tile_id", "n", "q", R("iou").alias("iou"), R("dice").alias("dice"), "threshold")


@query("tiles", "SELECT role, count(*) AS n, CAST(sum(CAST(('0x' || substr(h, 1, 10)) AS BIGINT)) AS VARCHAR) AS digest_a, CAST(sum(CAST(('0x' || substr(h, 11, 10)) AS BIGINT)) AS VARCHAR) AS digest_b FROM (SELECT role, sha1(concat_ws('|', cast(tile_id AS varchar), dca, cast(source_id AS varchar))) AS h FROM tiles) GROUP BY role")
def dataset_fingerprint(v: Views):
    return io.dataset_fingerprint(v.tiles, "role", ["tile_id", "dca", "source_id"])


@query("tiles buckets", "SELECT count(*) AS n, count(*) FILTER (NOT has_mask) AS missing, round(count(*) FILTER (NOT has_mask) / count(*), 6) AS ratio, count(*) FILTER (NOT has_mask) / count(*) <= 0.02 AS ok FROM tiles JOIN buckets USING (tile_id)")
def presence_guard(v: Views):
    return io.presence_guard(v.tiles, v.buckets.where("has_mask"), fail=False).withColumn("ratio", R("ratio"))


@query("pixels", "SELECT tile_id, y, " + ", ".join(f"CAST(sum({c} * (x + 1)) AS BIGINT) AS {c}" for c in ("r", "g", "b", "nir")) + ", " + ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 << x ELSE 0 END) AS BIGINT) AS {c}" for c in ("gt", "prior", "ign")) + ", count(*) AS n FROM pixels GROUP BY 1, 2")
def read_raster_layers(v: Views):
    """All pixels written as PNG layers and read back, by line: bands by place, and flags as bits."""
    root = scratch(v.spark).removeprefix("file://")
    io.write_raster_layers(v.pixels, root)
    px = io.read_raster_layers(v.spark, root)
    bands = [F.sum(F.col(c) * (F.col("x") + 1)).cast("long").alias(c) for c in ("r", "g", "b", "nir")]
    flags = [F.sum(F.when(F.col(c), F.expr("shiftleft(1L, x)")).otherwise(0)).cast("long").alias(c) for c in ("gt", "prior", "ign")]
    return px.groupBy(F.col("tile_id").cast("long").alias("tile_id"), "y").agg(*bands, *flags, F.count(F.lit(1)).alias("n"))


BOXES = """boxes AS (SELECT poly_id AS tile_id, cx - 150 AS xmin, cy - 150 AS ymin, cx + 150 AS xmax, cy + 150 AS ymax, r0 * 20 AS size_px FROM poly)"""


@query("poly", f"WITH {BOXES} SELECT tile_id, concat_ws(',', printf('%.1f', xmin), printf('%.1f', ymin), printf('%.1f', xmax), printf('%.1f', ymax)) AS bbox, concat_ws(',', least(size_px, 4000), least(size_px, 4000)) AS size, '0,1,2,3' AS bands, 'tiff' AS format, size_px > 4000 AS capped FROM boxes")
def request_plan(v: Views):
    t = v.poly.selectExpr("poly_id as tile_id", "cx - 150 as xmin", "cy - 150 as ymin", "cx + 150 as xmax", "cy + 150 as ymax", "r0 * 20 as size_px")
    return io.request_plan(t)


# --- projections and scalars -----------------------------------------------------------------------------------


def _lambert_sql() -> str:
    p = geo.Lambert()
    n, f, r0 = p.constants
    e = p.e
    return f"""WITH a AS (SELECT tile_id, lon, lat, radians(lat) AS phi FROM tiles),
b AS (SELECT *, {p.a * f!r} * pow(tan({3.141592653589793 / 4!r} - phi / 2) / pow((1 - {e!r} * sin(phi)) / (1 + {e!r} * sin(phi)), {e / 2!r}), {n!r}) AS r, {n!r} * radians(lon - ({p.lon0!r})) AS th FROM a)
SELECT tile_id, round({p.x0_m!r} + r * sin(th), 3) AS x, round({p.y0_m!r} + {r0!r} - r * cos(th), 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM b"""


@query("tiles", _lambert_sql())
def reproject(v: Views):
    there = geo.reproject(v.tiles.select("tile_id", "lon", "lat"), "lambert")
    back = geo.reproject(there.drop("lon", "lat"), "wgs84")
    return back.select("tile_id", R("x", 3).alias("x"), R("y", 3).alias("y"), R("lon").alias("lon"), R("lat").alias("lat"))


MEASURES = """e AS (SELECT poly_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM vert WINDOW w AS (PARTITION BY poly_id ORDER BY k)),
m AS (SELECT poly_id, sum(x*ny - nx*y) AS c, sum((x+nx)*(x*ny - nx*y)) AS sx, sum((y+ny)*(x*ny - nx*y)) AS sy, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM e GROUP BY poly_id)"""


@query("vert", f"WITH {MEASURES} SELECT poly_id, round(abs(c/2), 3) AS area_m2, xmin, ymin, xmax, ymax, greatest(xmax-xmin, ymax-ymin) AS extent_m, round(sx/(3*c), 3) AS cx, round(sy/(3*c), 3) AS cy FROM m")
def polygon_measures(v: Views):
    return geo.polygon_measures(v.vert).withColumns({"area_m2": R("area_m2", 3), "cx": R("cx", 3), "cy": R("cy", 3)})


@query("vert", f"WITH {MEASURES}, w AS (SELECT poly_id, greatest(greatest(xmax-xmin, ymax-ymin) * 1.5, 180.0) AS want FROM m), z AS (SELECT poly_id, CASE WHEN want <= 1500 THEN want END AS window_m FROM w), s AS (SELECT *, CASE WHEN window_m IS NOT NULL THEN least(greatest(CAST(round_even(window_m/0.3, 0) AS INT), 512), 2048) END AS size_px FROM z) SELECT poly_id, window_m, size_px, round(window_m/size_px, 6) AS gsd_m FROM s")
def window_and_size(v: Views):
    return geo.window_and_size(geo.polygon_measures(v.vert)).select("poly_id", "window_m", "size_px", R("gsd_m").alias("gsd_m"))


@query("poly", "SELECT poly_id, cx - r0 AS xmin, cy - r0 AS ymin, cx + r0 AS xmax, cy + r0 AS ymax, round(cx - 1.3 * r0 / 2, 6) AS ext_xmin, round(least(cx - 10, cx + 5 - r0) + (greatest(cx + 10, cx + 5 + r0) - least(cx - 10, cx + 5 - r0)) / 2 - greatest(greatest(cx + 10, cx + 5 + r0) - least(cx - 10, cx + 5 - r0), greatest(cy + 10, cy + r0) - least(cy - 10, cy - r0)) * 1.3 / 2, 6) AS pair_xmin FROM poly")
def square_bbox(v: Views):
    p = v.poly.select("poly_id", "cx", "cy", (F.col("r0") * 2).alias("window_m"), F.col("r0").alias("extent_m"), "r0")
    a = geo.square_bbox(p).select("poly_id", "xmin", "ymin", "xmax", "ymax")
    b = geo.square_bbox(p, "extent_m", "extent").select("poly_id", R("xmin").alias("ext_xmin"))
    pair = p.selectExpr("poly_id", "cx - 10 as a_xmin", "cx + 10 as a_xmax", "cy - 10 as a_ymin", "cy + 10 as a_ymax", "cx + 5 - r0 as b_xmin", "cx + 5 + r0 as b_xmax", "cy - r0 as b_ymin", "cy + r0 as b_ymax")
    c = geo.square_bbox(pair, mode="pair").select("poly_id", R("xmin").alias("pair_xmin"))
    return a.join(b, "poly_id").join(c, "poly_id")


@query("poly vert", "SELECT poly_id, k, round((x - (cx - 600)) / 2.5, 6) AS px, round((cy + 600 - y) / 2.5, 6) AS py, round(x, 6) AS x, round(y, 6) AS y FROM vert JOIN poly USING (poly_id)")
def geo_to_pixel(v: Views):
    t = v.vert.join(v.poly.selectExpr("poly_id", "cx - 600 as xmin", "cy + 600 as ymax", "2.5d as gsd_m"), "poly_id")
    back = geo.geo_to_pixel(geo.geo_to_pixel(t).drop("x", "y"), inverse=True)
    return back.select("poly_id", "k", *(R(c).alias(c) for c in ("px", "py", "x", "y")))


@query("pixels", """WITH c AS (SELECT tile_id, r/255.0::DOUBLE AS r, g/255.0::DOUBLE AS g, b/255.0::DOUBLE AS b, nir/255.0::DOUBLE AS n FROM pixels)
SELECT tile_id, round(avg((n-r)/(n+r+1e-6)), 6) AS ndvi, round(avg((r-g)/(r+g+1e-6)), 6) AS redness, round(avg((g-r)/(g+r+1e-6)), 6) AS ngrdi, round(avg((r+g+b)/3), 6) AS brightness, round(avg(2*g-r-b), 6) AS exg, round(avg((n-r)/(n+r+1/255.0::DOUBLE)), 6) AS ndvi_bytes, round(avg((r-g)/(r+g+1e-3)), 6) AS redness_classifier FROM c GROUP BY tile_id""")
def spectral_indices(v: Views):
    m = {"ndvi": sp.ndvi(), "redness": sp.redness(), "ngrdi": sp.ngrdi(), "brightness": sp.brightness(), "exg": sp.excess_green(), "ndvi_bytes": sp.ndvi(sp.EPSILON["bytes"]), "redness_classifier": sp.redness(sp.EPSILON["classifier"])}
    return v.pixels.groupBy("tile_id").agg(*(R(F.avg(c)).alias(n) for n, c in m.items()))


@query("pixels", "SELECT tile_id, round(avg((r-g)/(r+g+1.0::DOUBLE) + 0.5*greatest(0.0, 0.35 - (nir-r)/(nir+r+1.0::DOUBLE))), 6) AS score FROM pixels GROUP BY tile_id")
def damage_score(v: Views):
    return v.pixels.groupBy("tile_id").agg(R(F.avg(sp.damage_score())).alias("score"))


@query("pixels", "SELECT tile_id, round(sum(r/255.0::DOUBLE), 4) AS r, round(sum((g/255.0::DOUBLE - 0.456)/0.224), 4) AS g FROM pixels GROUP BY tile_id")
def normalize_bands(v: Views):
    return v.pixels.groupBy("tile_id").agg(R(F.sum(sp.normalized("r")), 4).alias("r"), R(F.sum(sp.normalized("g", 0.456, 0.224)), 4).alias("g"))


@query("pixels", "SELECT tile_id, count(*) FILTER (NOT (r=0 AND g=0 AND b=0) AND nir <> 255) AS valid, count(*) FILTER (NOT (r=0 AND g=0 AND b=0) AND nir <> 255 AND gt) AS damage FROM pixels GROUP BY tile_id")
def valid_pixels(v: Views):
    ok = sp.valid("nir")
    return v.pixels.groupBy("tile_id").agg(F.count_if(ok).alias("valid"), F.count_if(ok & F.col("gt")).alias("damage"))


@query("poly", f"SELECT poly_id, {SEVERITY} AS severity FROM poly")
def severity_rank(v: Views):
    return v.poly.select("poly_id", select.severity_rank("pct_affected").alias("severity"))


KIND = "CASE lower(trim(label)) WHEN 'prior' THEN 'guide' WHEN 'ignore' THEN 'ignore' WHEN 'unsure' THEN 'ignore' WHEN 'reject' THEN 'reject' WHEN 'clean' THEN 'clean' ELSE 'damage' END"


@query("annotations", f"SELECT {KIND} AS kind, count(*) AS n FROM annotations GROUP BY 1")
def label_taxonomy(v: Views):
    return v.annotations.groupBy(annotate.label_taxonomy("label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


RINGS = f"""pts AS (SELECT ann_id, tile_id, {KIND} AS kind, shape_type, {POINTS_SQL} AS p FROM annotations),
rings AS (SELECT ann_id, tile_id, kind, CASE shape_type WHEN 'polygon' THEN CASE WHEN len(p) >= 3 THEN p END WHEN 'rectangle' THEN [[p[1][1], p[1][2]], [p[2][1], p[1][2]], [p[2][1], p[2][2]], [p[1][1], p[2][2]]]
 WHEN 'circle' THEN list_transform(range(48), lambda k: [p[1][1] + sqrt((p[2][1]-p[1][1])*(p[2][1]-p[1][1]) + (p[2][2]-p[1][2])*(p[2][2]-p[1][2])) * cos(6.283185307179586*k/48), p[1][2] + sqrt((p[2][1]-p[1][1])*(p[2][1]-p[1][1]) + (p[2][2]-p[1][2])*(p[2][2]-p[1][2])) * sin(6.283185307179586*k/48)]) END AS ring FROM pts)"""


@query("annotations", f"WITH {RINGS} SELECT ann_id, len(ring) AS n, round(list_sum(list_transform(ring, lambda q: q[1])), 6) AS sx, round(list_sum(list_transform(ring, lambda q: q[2])), 6) AS sy FROM rings")
def shape_to_polygon(v: Views):
    s = annotate.shape_table(v.annotations)
    total = lambda i: R(F.aggregate("ring", F.lit(0.0), lambda a, p: a + F.get(p, F.lit(i))))
    return s.select("ann_id", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n"), total(0).alias("sx"), total(1).alias("sy"))


AFFINE = "SELECT poly_id, 0.9 AS a, -0.2 AS b, 5.0 AS tx, 0.2 AS c, 1.1 AS d, -3.0 AS ty FROM poly"


@query("vert", "WITH m AS (SELECT *, avg(x) OVER (PARTITION BY poly_id) AS ox, avg(y) OVER (PARTITION BY poly_id) AS oy FROM vert) SELECT poly_id, k, round(ox + 0.9*(x-ox) - 0.2*(y-oy) + 5, 4) AS x, round(oy + 0.2*(x-ox) + 1.1*(y-oy) - 3, 4) AS y FROM m")
def affine_polygon(v: Views):
    params = v.poly.selectExpr("poly_id", "0.9d as a", "-0.2d as b", "5d as tx", "0.2d as c", "1.1d as d", "-3d as ty")
    return geo.affine_polygon(v.vert, params).withColumns({"x": R("x", 4), "y": R("y", 4)})


@query()
def affine_augment(v: Views):
    phases = v.spark.createDataFrame([(1, 10.0, 5.0, 2.0, 0.05), (2, 40.0, 20.0, 8.0, 0.2)], "phase int, max_shift double, max_turn double, max_shear double, max_scale double")
    return geo.affine_augment(v.poly, phases, 3, 7)


# --- filters and worklists -------------------------------------------------------------------------------------


@query("poly", """WITH f AS (SELECT damage_type = 'Mortality' AS a, coalesce(area_type = 'POLYGON', false) AS b, pct_affected <> 'Very Light (1-3%)' AS c, cx BETWEEN 100000 AND 500000 AS d, r0 <= 300 AS e FROM poly)
SELECT unnest([0,1,2,3,4,5]) AS stage, unnest(['all','mortality','polygon','severity','box','fits']) AS name, unnest([count(*), count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND d), count(*) FILTER (a AND b AND c AND d AND e)]) AS rows FROM f""")
def filter_funnel(v: Views):
    stages = [("mortality", F.expr("damage_type = 'Mortality'")), ("polygon", F.expr("area_type = 'POLYGON'")), ("severity", F.expr("pct_affected <> 'Very Light (1-3%)'")), ("box", F.expr("cx between 100000 and 500000")), ("fits", F.expr("r0 <= 300"))]
    return select.filter_funnel(v.poly, stages)[1]


@query("pixels", "WITH s AS (SELECT tile_id, sqrt(greatest(0, sum(r*r+g*g+b*b)/(3.0::DOUBLE*count(*)) - (sum(r+g+b)/(3.0::DOUBLE*count(*)))*(sum(r+g+b)/(3.0::DOUBLE*count(*))))) AS std, avg(CASE WHEN r > 250 AND g > 250 AND b > 250 THEN 1.0 ELSE 0.0 END) AS white FROM pixels GROUP BY tile_id) SELECT tile_id, round(std, 4) AS std, round(white, 6) AS white, std >= 3 AND white <= 0.6 AS ok FROM s")
def blank_tile_guard(v: Views):
    return select.blank_tile_guard(v.pixels).withColumns({"std": R("std", 4), "white": R("white")})


@query("annotations buckets", "WITH d AS (SELECT tile_id, bool_and(version = '5.5.0') AS draft FROM annotations GROUP BY tile_id) SELECT tile_id, draft, draft AND tile_id IN (SELECT tile_id FROM buckets WHERE has_mask) AS stale_mask FROM d")
def draft_guard(v: Views):
    return select.draft_guard(v.annotations, v.buckets.where("has_mask"))


QUEUE = "WITH ix AS (SELECT tile_id, role, tiles.dca, pct_affected FROM tiles JOIN poly ON tile_id = poly_id)"


@query("tiles poly annotations buckets", QUEUE + " SELECT tile_id, dca, pct_affected, count(*) OVER (PARTITION BY dca) AS n FROM ix WHERE role = 'damage' AND pct_affected IN ('Severe (30-50%)', 'Moderate (11-29%)') AND dca IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#10') AND tile_id NOT IN (SELECT tile_id FROM annotations WHERE version = '6.3.1') AND tile_id IN (SELECT tile_id FROM buckets WHERE has_mask)")
def annotation_queue(v: Views):
    ix = v.tiles.join(v.poly.select(F.col("poly_id").alias("tile_id"), "pct_affected"), "tile_id")
    out = select.annotation_queue(ix, v.annotations.where("version = '6.3.1'"), v.buckets.where("has_mask"), ["Severe (30-50%)", "Moderate (11-29%)"], ["Brand#1", "Brand#2", "Brand#3", "Brand#10"])
    return out.select("tile_id", "dca", "pct_affected").join(select.queue_counts(out), "dca")


@query("tiles annotations buckets", "SELECT tile_id, role FROM tiles WHERE tile_id >= 10 AND tile_id NOT IN (SELECT tile_id FROM buckets WHERE bucket IS NOT NULL) AND tile_id NOT IN (SELECT tile_id FROM annotations WHERE label = 'reject') AND tile_id NOT IN (SELECT tile_id FROM buckets WHERE has_mask)")
def review_worklist(v: Views):
    b = v.buckets
    return select.review_worklist(v.tiles, b.where("bucket is not null"), v.annotations.where("label = 'reject'"), b.where("has_mask"), 10).select("tile_id", "role")


@query("tiles annotations", "SELECT tile_id FROM tiles WHERE tile_id NOT IN (SELECT tile_id FROM annotations)")
def unlabelled_report(v: Views):
    return select.unlabelled_report(v.tiles, v.annotations).select("tile_id")


# --- joins -----------------------------------------------------------------------------------------------------


@query("poly", "SELECT observation_id, poly_id FROM poly WHERE poly_id % 3 <> 0")
def exclude_known(v: Views):
    return select.exclude_known(v.poly, v.poly.where("poly_id % 3 = 0")).select("observation_id", "poly_id")


@query("tiles buckets", "SELECT tile_id, bucket, window_m, dca FROM buckets JOIN tiles USING (tile_id) WHERE has_mask AND role = 'damage'")
def tile_meta_join(v: Views):
    return select.tile_meta_join(v.buckets.withColumnRenamed("has_mask", "use"), v.tiles.where("role = 'damage'").select("tile_id", "window_m", "dca")).select("tile_id", "bucket", "window_m", "dca")


@query("survey_pairs", "SELECT damage_area_id, checked, dx, dy, s FROM survey_pairs WHERE checked IN ('Reshape', 'Resahpe') AND transform = 'Reshape'")
def pair_corrections(v: Views):
    p = v.survey_pairs
    return select.pair_corrections(p.select("damage_area_id", "checked"), p.select("damage_area_id", "transform", "dx", "dy", "s")).drop("transform")


@query("survey_pairs", "WITH a AS (SELECT damage_area_id AS id, CASE damage_area_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('{', damage_area_id * 2, '}') END AS notes FROM survey_pairs), o AS (SELECT DISTINCT concat('{', damage_area_id, '}') AS k FROM survey_pairs) SELECT CASE WHEN coalesce(trim(notes), '') = '' THEN 'no id' WHEN k IS NULL THEN 'not found' ELSE 'matched' END AS outcome, count(*) AS n FROM a LEFT JOIN o ON notes = k GROUP BY 1")
def link_observations(v: Views):
    a = v.survey_pairs.selectExpr("damage_area_id", "case damage_area_id % 7 when 0 then '' when 1 then null else concat('{', damage_area_id * 2, '}') end as notes")
    return select.link_observations(a, v.poly).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("tiles runs", "SELECT run_id AS tile_id, iou, dca, role FROM runs LEFT JOIN tiles ON run_id = tile_id")
def metrics_join(v: Views):
    return select.metrics_join(v.runs.selectExpr("run_id as tile_id", "iou"), v.tiles.select("tile_id", "dca", "role"))


EDGES = """e AS (SELECT region_id, kind, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM survey_regions WINDOW w AS (PARTITION BY region_id ORDER BY k)),
ins AS (SELECT cand_id, region_id, kind FROM neg_candidates, e WHERE ((y <= cy AND cy < ny) OR (ny <= cy AND cy < y)) AND x + (cy - y) * (nx - x) / (ny - y) > cx GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
cut AS (SELECT cand_id, region_id, kind, CASE WHEN nx = x THEN (CASE WHEN abs(x - cx) <= 150 THEN 0.0 ELSE 2.0 END) ELSE least((cx-150-x)/(nx-x), (cx+150-x)/(nx-x)) END AS ax, CASE WHEN nx = x THEN 1.0 ELSE greatest((cx-150-x)/(nx-x), (cx+150-x)/(nx-x)) END AS bx,
 CASE WHEN ny = y THEN (CASE WHEN abs(y - cy) <= 150 THEN 0.0 ELSE 2.0 END) ELSE least((cy-150-y)/(ny-y), (cy+150-y)/(ny-y)) END AS ay, CASE WHEN ny = y THEN 1.0 ELSE greatest((cy-150-y)/(ny-y), (cy+150-y)/(ny-y)) END AS "by" FROM neg_candidates, e),
crossed AS (SELECT DISTINCT cand_id, region_id, kind FROM cut WHERE greatest(0.0, ax, ay) <= least(1.0, bx, "by")),
inside AS (SELECT cand_id, cx, cy FROM neg_candidates WHERE cand_id IN (SELECT cand_id FROM ins i WHERE kind = 'surveyed' AND NOT EXISTS (SELECT 1 FROM crossed c WHERE c.cand_id = i.cand_id AND c.region_id = i.region_id))
 AND cand_id NOT IN (SELECT cand_id FROM ins WHERE kind = 'not_flown') AND cand_id NOT IN (SELECT cand_id FROM crossed WHERE kind = 'not_flown'))"""


@query("neg_candidates survey_regions", f"WITH {EDGES} SELECT * FROM inside")
def within_region(v: Views):
    return spatial.within_region(v.neg_candidates, 150, v.survey_regions)


@query("neg_candidates vert", """WITH bb AS (SELECT poly_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vert GROUP BY poly_id),
pr AS (SELECT cand_id, cx, cy, poly_id FROM neg_candidates JOIN bb ON x0 <= cx + 300 AND x1 >= cx - 300 AND y0 <= cy + 300 AND y1 >= cy - 300),
ed AS (SELECT poly_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM vert WINDOW w AS (PARTITION BY poly_id ORDER BY k)),
hit AS (SELECT cand_id FROM pr JOIN ed USING (poly_id) GROUP BY cand_id, poly_id HAVING bool_or(greatest(0.0, CASE WHEN nx = x THEN (CASE WHEN abs(x - cx) <= 300 THEN 0.0 ELSE 2.0 END) ELSE least((cx-300-x)/(nx-x), (cx+300-x)/(nx-x)) END, CASE WHEN ny = y THEN (CASE WHEN abs(y - cy) <= 300 THEN 0.0 ELSE 2.0 END) ELSE least((cy-300-y)/(ny-y), (cy+300-y)/(ny-y)) END) <= least(1.0, CASE WHEN nx = x THEN 1.0 ELSE greatest((cx-300-x)/(nx-x), (cx+300-x)/(nx-x)) END, CASE WHEN ny = y THEN 1.0 ELSE greatest((cy-300-y)/(ny-y), (cy+300-y)/(ny-y)) END))
 OR count(*) FILTER (((y <= cy AND cy < ny) OR (ny <= cy AND cy < y)) AND x + (cy - y) * (nx - x) / (ny - y) > cx) % 2 = 1)
SELECT cand_id, cx, cy FROM neg_candidates WHERE cand_id NOT IN (SELECT cand_id FROM hit)""")
def clear_of_features(v: Views):
    return spatial.clear_of_features(v.neg_candidates, 150, v.vert)


@query("neg_candidates poly", "SELECT cand_id, cx, cy FROM neg_candidates c WHERE NOT EXISTS (SELECT 1 FROM poly p WHERE (p.cx-c.cx)*(p.cx-c.cx) + (p.cy-c.cy)*(p.cy-c.cy) < 640000)")
def min_spacing_to(v: Views):
    return spatial.min_spacing_to(v.neg_candidates, v.poly.selectExpr("cx as x", "cy as y"), 800)


# a fold over all candidates in order: [id, earlier ids within reach ...] joins the kept ones unless it has one of them
@query("neg_candidates", """WITH nb AS (SELECT a.cand_id, list(b.cand_id) AS near FROM neg_candidates a JOIN neg_candidates b ON b.cand_id < a.cand_id AND abs(a.cx - b.cx) < 8000 AND abs(a.cy - b.cy) < 8000 AND (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) < 64000000 GROUP BY 1),
xs AS (SELECT list(list_prepend(c.cand_id, coalesce(near, [])) ORDER BY c.cand_id) AS l FROM neg_candidates c LEFT JOIN nb USING (cand_id)),
kp AS (SELECT unnest(list_reduce(l, lambda acc, x: CASE WHEN list_has_any(acc, x[2:]) THEN acc ELSE list_append(acc, x[1]) END, CAST([] AS BIGINT[]))) AS cand_id FROM xs)
SELECT cand_id, cx, cy FROM neg_candidates SEMI JOIN kp USING (cand_id)""")
def spaced_sample(v: Views):
    return spatial.spaced_sample(v.neg_candidates, 8000)


@query()
def confirmed_negatives(v: Views):
    present = v.neg_candidates.where("cand_id % 5 <> 0").select("cand_id")
    return spatial.confirmed_negatives(v.neg_candidates, v.survey_regions, v.vert, v.poly.selectExpr("cx as x", "cy as y"), present, spacing=8000)


def _pair(v: Views):
    p = v.survey_pairs.select(F.col("damage_area_id").alias("poly_id"), "dx", "dy", "s")
    w = v.vert.join(v.poly.select("poly_id", "cx", "cy"), "poly_id").join(p, "poly_id")
    return w.select("poly_id", "k", (F.col("cx") + F.col("dx") + F.col("s") * (F.col("x") - F.col("cx"))).alias("x"), (F.col("cy") + F.col("dy") + F.col("s") * (F.col("y") - F.col("cy"))).alias("y"))


SIDES = """bt AS (SELECT poly_id, 'a' AS part, k, x, y FROM vert UNION ALL SELECT poly_id, 'b', k, cx + dx + s*(x - cx), cy + dy + s*(y - cy) FROM vert JOIN poly USING (poly_id) JOIN survey_pairs ON damage_area_id = poly_id),
e0 AS (SELECT poly_id, part, k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, first_value(x) OVER w AS ox, first_value(y) OVER w AS oy FROM bt WINDOW w AS (PARTITION BY poly_id, part ORDER BY k)),
e1 AS (SELECT *, (x-ox)*(ny-oy) - (nx-ox)*(y-oy) AS c FROM e0),
m0 AS (SELECT poly_id, part, abs(sum(c))/2 AS area, sign(sum(c)) AS turn, min(ox) + sum((x-ox + nx-ox)*c)/(3*sum(c)) AS mx, min(oy) + sum((y-oy + ny-oy)*c)/(3*sum(c)) AS my FROM e1 GROUP BY 1, 2),
m AS (SELECT a.poly_id, a.area AS area_a, b.area AS area_b, a.turn*b.turn AS turn, a.mx AS mx_a, a.my AS my_a, b.mx AS mx_b, b.my AS my_b FROM m0 a JOIN m0 b ON a.poly_id = b.poly_id AND a.part = 'a' AND b.part = 'b'),
h0 AS (SELECT poly_id, how, part, CASE WHEN part = 'a' OR how = 'raw' THEN mx_a ELSE mx_b END AS ux, CASE WHEN part = 'a' OR how = 'raw' THEN my_a ELSE my_b END AS uy, CASE WHEN part = 'b' AND how = 'scaled' THEN sqrt(area_a/area_b) ELSE 1.0::DOUBLE END AS f, x, y, nx, ny FROM e0 JOIN m USING (poly_id), (VALUES ('raw'), ('shift'), ('scaled')) AS v(how)),
h1 AS (SELECT poly_id, how, part, (x-ux)*f AS x, (y-uy)*f AS y, (nx-ux)*f AS nx, (ny-uy)*f AS ny FROM h0),
h2 AS (SELECT poly_id, how, part, x, y - base AS y, (ny - y)/(nx - x) AS t, sign(x - nx) AS g, least(x, nx) AS lo, greatest(x, nx) AS hi FROM (SELECT *, min(y) OVER (PARTITION BY poly_id, how) AS base FROM h1) WHERE x <> nx),
j AS (SELECT poly_id, how, a.g*b.g AS g, greatest(a.lo, b.lo) AS u, least(a.hi, b.hi) AS v, a.x AS ax, a.y AS ay, a.t AS a_t, b.x AS bx, b.y AS b_y, b.t AS b_t FROM h2 a JOIN h2 b USING (poly_id, how) WHERE a.part = 'a' AND b.part = 'b' AND greatest(a.lo, b.lo) < least(a.hi, b.hi)),
l AS (SELECT poly_id, how, g, v - u AS w, ay + (u-ax)*a_t AS au, ay + (v-ax)*a_t AS av, b_y + (u-bx)*b_t AS bu, b_y + (v-bx)*b_t AS bv FROM j),
o AS (SELECT poly_id, how, g*w/2*CASE WHEN (au-bu)*(av-bv) >= 0 THEN least(au, bu) + least(av, bv) ELSE (au-bu)/(au-bu-av+bv)*least(au, bu) + (av-bv)/(av-bv-au+bu)*least(av, bv) + au + (au-bu)/(au-bu-av+bv)*(av-au) END AS z FROM l),
sh AS (SELECT poly_id, sum(z) FILTER (how = 'raw') AS raw, sum(z) FILTER (how = 'shift') AS shift, sum(z) FILTER (how = 'scaled') AS scaled FROM o GROUP BY 1),
ov AS (SELECT poly_id, coalesce(turn*raw, 0)/(area_a + area_b - coalesce(turn*raw, 0)) AS iou_raw, turn*shift/(area_a + area_b - turn*shift) AS iou_shift, turn*scaled/(area_a + area_a - turn*scaled) AS iou_scaled, sqrt((mx_a-mx_b)*(mx_a-mx_b) + (my_a-my_b)*(my_a-my_b)) AS shift_m, area_b/area_a AS area_ratio FROM m LEFT JOIN sh USING (poly_id))"""
OVERLAPS = ("iou_raw", "iou_shift", "iou_scaled", "shift_m", "area_ratio")


# no area is below nothing: what disjoint polygons' terms leave of each other by rounding has no sign
@query("poly vert survey_pairs", f"WITH {SIDES} SELECT poly_id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in OVERLAPS)} FROM ov UNION ALL SELECT NULL, {', '.join(f'round(median({c}), 6)' for c in OVERLAPS)} FROM ov")
def polygon_overlap(v: Views):
    out = materialize(spatial.polygon_overlap(v.vert, _pair(v)))
    every = out.select("poly_id", *((R(c) + 0.0).alias(c) for c in OVERLAPS))
    return every.unionByName(spatial.overlap_medians(out).select(F.lit(None).cast("long").alias("poly_id"), *(R(c).alias(c) for c in OVERLAPS)))


@query("survey_pairs", "WITH s AS (SELECT checked, sqrt(dx*dx+dy*dy) AS m FROM survey_pairs) SELECT checked, count(*) AS n, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(min(m), 6) AS min, round(max(m), 6) AS max, round(stddev_pop(m), 6) AS std FROM s GROUP BY checked")
def pair_shift_stats(v: Views):
    p = v.survey_pairs.withColumn("shift_m", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    out = spatial.pair_shift_stats(p, "checked")
    return out.select("checked", "n", *(R(c).alias(c) for c in ("mean", "median", "min", "max", "std")))


# --- ordering and sampling -------------------------------------------------------------------------------------


def _first_rows(v: Views, mode: str):
    from standmap.sources.store import row_numbers

    order = {"largest": [F.desc("r0"), F.col("poly_id")], "random": [select.seeded("poly_id", 42), F.col("poly_id")]}[mode]
    return row_numbers(v.poly.select("poly_id", "r0"), order).select(F.lit(mode).alias("mode"), "rn", "poly_id")


@query("poly", f"SELECT 'largest' AS mode, row_number() OVER (ORDER BY r0 DESC, poly_id) AS rn, poly_id FROM poly UNION ALL SELECT 'random', row_number() OVER (ORDER BY {RAND.format(id='poly_id')}, poly_id), poly_id FROM poly")
def candidate_order(v: Views):
    return _first_rows(v, "largest").unionByName(_first_rows(v, "random"))


@query("poly", f"WITH t AS (SELECT poly_id, dca, row_number() OVER (PARTITION BY dca ORDER BY {SEVERITY} DESC, r0 DESC, poly_id) AS turn FROM poly) SELECT poly_id, dca, turn FROM t")
def interleave_groups(v: Views):
    p = v.poly.withColumn("sev", select.severity_rank("pct_affected"))
    return select.interleave_groups(p, "dca", [F.desc("sev"), F.desc("r0"), F.col("poly_id")]).select("poly_id", "dca", "turn")


@query("poly", "WITH a AS (SELECT poly_id, host, dca, row_number() OVER (PARTITION BY host, dca ORDER BY r0 DESC, poly_id) AS i, min(poly_id) OVER (PARTITION BY host, dca) AS f FROM poly) SELECT poly_id, host, dca, row_number() OVER (PARTITION BY host ORDER BY i, f) AS turn FROM a")
def interleave_nested(v: Views):
    return select.interleave_nested(v.poly, "host", "dca", [F.desc("r0"), F.col("poly_id")]).select("poly_id", "host", "dca", "turn")


@query("poly", "SELECT poly_id, 99 + row_number() OVER (ORDER BY r0 DESC, poly_id) AS new_id FROM poly WHERE poly_id % 4 <> 1 QUALIFY row_number() OVER (ORDER BY r0 DESC, poly_id) <= 500")
def take_until(v: Views):
    return select.take_until(v.poly, v.poly.where("poly_id % 4 <> 1"), 500, 100, [F.desc("r0"), F.col("poly_id")]).select("poly_id", "new_id")


@query("tiles", f"WITH a AS (SELECT CAST(round_even(0.25 * count(*) FILTER (role = 'damage'), 0) AS BIGINT) AS want, count(*) FILTER (role = 'negative') AS have, count(DISTINCT source_id) FILTER (role = 'negative') AS sources FROM tiles), n AS (SELECT tile_id, source_id, {RAND.format(id='tile_id')} AS o, row_number() OVER (PARTITION BY source_id ORDER BY {RAND.format(id='tile_id')}, tile_id) AS r FROM tiles WHERE role = 'negative'), k AS (SELECT n.*, want, have, row_number() OVER (ORDER BY o, tile_id) AS q FROM n, a WHERE have <= want OR r <= greatest(1, want // greatest(1, sources) + 1)) SELECT tile_id, source_id FROM k WHERE have <= want OR q <= want")
def capped_negatives(v: Views):
    return select.capped_negatives(v.tiles, 0.25, 42, "tile_id").select("tile_id", "source_id")


@query("tiles", "WITH o AS (SELECT tile_id, row_number() OVER (ORDER BY tile_id) AS rn, count(*) OVER () AS n FROM tiles) SELECT tile_id FROM o WHERE rn IN (SELECT CAST(round_even(i * ((SELECT max(n) FROM o) - 1) / 99.0::DOUBLE, 0) AS BIGINT) + 1 FROM (SELECT range AS i FROM range(100)))")
def even_subsample(v: Views):
    return select.even_subsample(v.tiles.select("tile_id"), 100, ["tile_id"])


@query("tiles", f"WITH n AS (SELECT tile_id, role, row_number() OVER (ORDER BY {RAND.format(id='tile_id')}, tile_id) AS q FROM tiles WHERE role = 'negative') SELECT tile_id, role FROM tiles WHERE role = 'damage' UNION ALL SELECT tile_id, role FROM n WHERE q <= (SELECT floor(count(*) * 0.25) FROM tiles WHERE role = 'damage')")
def ratio_sample(v: Views):
    return select.ratio_sample(v.tiles.withColumn("pos", F.col("role") == "damage"), "pos").select("tile_id", "role")


@query("pixels", "SELECT tile_id, y, x, gt FROM pixels QUALIFY row_number() OVER (PARTITION BY tile_id, gt ORDER BY ((y*4096 + x)*7919 + 42*104729) % 1000003, y, x) <= 10")
def per_class_sample(v: Views):
    return select.per_class_sample(v.pixels.select("tile_id", "y", "x", "gt"), "gt", 10)


@query("runs", "SELECT run_id, iou FROM runs WHERE iou IS NOT NULL QUALIFY (row_number() OVER (ORDER BY iou DESC, run_id) - 1) % 25 = 0")
def stride_sample(v: Views):
    return select.stride_sample(v.runs.where("iou is not null").select("run_id", "iou"), [F.desc("iou"), F.col("run_id")], 25)


PAGES = """x AS (SELECT run_id AS tile_id, iou, n_damage AS source, run_id % 7 = 0 AS floods, (run_id * 13 % 100)/100.0::DOUBLE AS painted FROM runs),
a AS (SELECT tile_id, 'best' AS kind, row_number() OVER (ORDER BY iou DESC, tile_id) AS rn FROM x WHERE iou IS NOT NULL UNION ALL SELECT tile_id, 'worst', row_number() OVER (ORDER BY iou, tile_id) FROM x WHERE iou IS NOT NULL
UNION ALL SELECT tile_id, 'flooded', row_number() OVER (ORDER BY source, iou DESC, tile_id) FROM x WHERE iou IS NOT NULL AND floods UNION ALL SELECT tile_id, 'negative', row_number() OVER (ORDER BY painted DESC, tile_id) FROM x WHERE iou IS NULL)"""


@query("runs", f"WITH {PAGES} SELECT tile_id, kind, rn, CAST(floor((rn - 1) / 36) AS BIGINT) AS page FROM a WHERE rn <= 72")
def extremes_pages(v: Views):
    x = v.runs.selectExpr("run_id as tile_id", "iou", "n_damage as source", "run_id % 7 = 0 as floods", "(run_id * 13 % 100) / 100.0d as painted")
    return select.extremes_pages(x, "iou", "source", "floods", "painted").select("tile_id", "kind", "rn", "page")


@query("poly", "WITH m AS (SELECT dca, damage_type, count(*) AS k FROM poly GROUP BY ALL), t AS (SELECT dca, damage_type FROM m QUALIFY row_number() OVER (PARTITION BY dca ORDER BY k DESC, damage_type) = 1), c AS (SELECT dca, count(*) AS n, round(avg(r0), 6) AS mean, min(r0) AS low, max(r0) AS high FROM poly GROUP BY dca) SELECT c.dca, n, mean, low, high, t.damage_type AS mode FROM c JOIN t ON c.dca IS NOT DISTINCT FROM t.dca")
def value_counts(v: Views):
    out = select.value_counts(v.poly, "dca", "r0", "damage_type")
    return out.withColumn("mean", R("mean"))


# --- annotation tables and sets --------------------------------------------------------------------------------


@query("annotations", f"WITH k AS (SELECT tile_id, {KIND} AS kind FROM annotations) SELECT tile_id, CASE WHEN bool_or(kind = 'reject') THEN 'reject' WHEN bool_or(kind = 'damage') THEN 'damage' WHEN bool_or(kind = 'clean') THEN 'clean' ELSE 'untouched' END AS verdict, CASE WHEN bool_or(kind = 'reject') THEN 'reject' WHEN bool_or(kind = 'damage') THEN 'damage' ELSE 'untouched' END AS verdict_negatives FROM k GROUP BY tile_id")
def tile_verdict(v: Views):
    other = annotate.tile_verdict(v.annotations, "negatives").withColumnRenamed("verdict", "verdict_negatives")
    return annotate.tile_verdict(v.annotations, "empty").join(other, "tile_id")


# two buckets for some tiles, masks without damage pixels for others, and a third of the negatives reviewed
MANIFEST = """bk AS (SELECT tile_id, bucket, CASE bucket WHEN 'delete' THEN 0 WHEN 'risky' THEN 1 WHEN 'too_small' THEN 2 WHEN 'no_damage' THEN 3 WHEN 'treecut_ignore' THEN 4 WHEN 'damage_ignore' THEN 5 WHEN 'on_hold' THEN 6 END AS o FROM (SELECT tile_id, CASE WHEN tile_id % 20 = 11 THEN 'too_small' ELSE bucket END AS bucket FROM buckets UNION ALL SELECT tile_id, 'no_damage' FROM buckets WHERE tile_id % 20 = 5) WHERE bucket IS NOT NULL),
lb AS (SELECT tile_id, max_by(bucket, o) AS bucket, count(DISTINCT bucket) AS nb FROM bk GROUP BY tile_id),
mk AS (SELECT tile_id, CASE WHEN has_mask THEN CASE WHEN tile_id % 4 = 0 THEN 0 ELSE 1 + tile_id % 50 END END AS px, tile_id % 6 = 0 AS ign FROM buckets),
mm AS (SELECT t.tile_id, coalesce(bucket, '(unlisted)') AS bucket, px IS NOT NULL AS has_mask, coalesce(px, -1) > 0 AS damage, coalesce(px, 0) AS px, coalesce(ign, false) AS ign, t.role AS ix, coalesce(nb, 0) > 1 AS twice, t.tile_id % 3 = 0 AS rev FROM tiles t LEFT JOIN lb USING (tile_id) LEFT JOIN mk USING (tile_id))"""


@query("tiles buckets", f"""WITH {MANIFEST} SELECT tile_id, bucket, has_mask, damage, ign AS ignore,
 CASE WHEN bucket IN ('delete', 'risky', 'too_small', 'on_hold') THEN 'exclude' WHEN bucket = 'no_damage' THEN CASE WHEN damage THEN 'damage' ELSE 'negative' END WHEN bucket = 'treecut_ignore' THEN CASE WHEN damage THEN 'damage' ELSE 'exclude' END WHEN bucket = 'damage_ignore' OR damage THEN 'damage' WHEN ix = 'negative' THEN CASE WHEN rev THEN 'negative' ELSE 'exclude' END WHEN has_mask THEN 'exclude' ELSE 'skip' END AS role,
 CASE WHEN bucket IN ('delete', 'risky', 'too_small', 'on_hold') THEN false WHEN bucket = 'no_damage' THEN true WHEN bucket = 'treecut_ignore' THEN damage WHEN bucket = 'damage_ignore' OR damage THEN true WHEN ix = 'negative' THEN rev ELSE false END AS use,
 concat_ws('; ', CASE WHEN twice THEN 'several buckets' END, CASE WHEN bucket = 'no_damage' AND damage THEN 'no_damage but ' || px || ' damage px' WHEN bucket = 'no_damage' AND NOT has_mask THEN 'no_damage without a mask' WHEN bucket = 'damage_ignore' AND NOT damage THEN 'damage_ignore without damage px' WHEN bucket = '(unlisted)' AND damage AND ix = 'negative' THEN 'negative in the index but ' || px || ' damage px' WHEN bucket = '(unlisted)' AND NOT damage AND ix <> 'negative' AND has_mask THEN 'empty and unlisted' END) AS warning FROM mm""")
def build_manifest(v: Views):
    b = v.buckets
    listed = b.select("tile_id", F.when(F.col("tile_id") % 20 == 11, "too_small").otherwise(F.col("bucket")).alias("bucket")).where("bucket is not null")
    listed = listed.unionByName(b.where("tile_id % 20 = 5").select("tile_id", F.lit("no_damage").alias("bucket")))
    masks = b.where("has_mask").select("tile_id", F.when(F.col("tile_id") % 4 == 0, 0).otherwise(1 + F.col("tile_id") % 50).cast("long").alias("damage_px"))
    ignored = b.where("tile_id % 6 = 0").select("tile_id")
    return annotate.build_manifest(v.tiles, listed, masks, ignored, v.tiles.where("tile_id % 3 = 0").select("tile_id"))


VERDICTS = f"vv AS (SELECT tile_id, CASE WHEN bool_or(kind = 'reject') THEN 'reject' WHEN bool_or(kind = 'damage') THEN 'damage' WHEN bool_or(kind = 'clean') THEN 'clean' ELSE 'untouched' END AS v FROM (SELECT tile_id, {KIND} AS kind FROM annotations) GROUP BY tile_id)"


def _verdicts(v: Views):
    return annotate.tile_verdict(v.annotations)


@query("annotations buckets", f"WITH {VERDICTS}, d AS (SELECT tile_id FROM buckets WHERE bucket = 'delete' UNION SELECT tile_id FROM vv WHERE v = 'reject'), n AS (SELECT tile_id FROM buckets WHERE bucket = 'no_damage' UNION SELECT tile_id FROM vv WHERE v = 'clean') SELECT 'delete' AS list, tile_id FROM d WHERE tile_id NOT IN (SELECT tile_id FROM vv WHERE v IN ('clean', 'damage')) UNION ALL SELECT 'no_damage', tile_id FROM n WHERE tile_id NOT IN (SELECT tile_id FROM vv WHERE v IN ('reject', 'damage'))")
def apply_verdicts(v: Views):
    b, w = v.buckets, _verdicts(v)
    return select.apply_verdicts(b.where("bucket = 'delete'"), b.where("bucket = 'no_damage'"), *(w.where(F.col("verdict") == x) for x in ("reject", "clean", "damage")))


@query("annotations buckets", f"WITH {VERDICTS} SELECT DISTINCT tile_id FROM vv WHERE v <> 'untouched' AND tile_id IN (SELECT tile_id FROM buckets WHERE bucket IS NOT NULL)")
def bucket_clash(v: Views):
    return select.bucket_clash(v.buckets, _verdicts(v).where("verdict <> 'untouched'"))


@query("annotations buckets", "SELECT tile_id FROM annotations UNION SELECT tile_id FROM buckets WHERE bucket IS NOT NULL")
def seen_set(v: Views):
    return select.seen_set(v.annotations, v.buckets.where("bucket is not null"))

