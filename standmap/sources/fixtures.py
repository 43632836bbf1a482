"""Views of the survey's tables, computed from the given ones by statements that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

#: The views of FIXTURES.md. {N} stands for a series i = 0 .. N-1.
VIEWS = {
    "poly": """SELECT concat('{', cast(o_orderkey AS string), '}') AS observation_id, o_orderkey AS poly_id,
 CASE WHEN (o_orderkey*7919+11) % 100 < 92 THEN 'Mortality' WHEN (o_orderkey*7919+11) % 100 < 96 THEN 'Topkill' ELSE 'Crown Dieback' END AS damage_type,
 CASE WHEN (o_orderkey*104729+5) % 100 < 50 THEN 'POLYGON' END AS area_type,
 CASE WHEN (o_orderkey*15485863+7) % 100 < 50 THEN 'Very Light (1-3%)' WHEN (o_orderkey*15485863+7) % 100 < 65 THEN 'Light (4-10%)'
  WHEN (o_orderkey*15485863+7) % 100 < 85 THEN 'Moderate (11-29%)' WHEN (o_orderkey*15485863+7) % 100 < 94 THEN 'Severe (30-50%)' ELSE 'Very Severe (>50%)' END AS pct_affected,
 CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS dca, cast(c_nationkey AS bigint) AS host,
 cast((o_orderkey*48611) % 600000 + 20000 AS double) AS cx, cast((o_orderkey*22541) % 480000 + 30000 AS double) AS cy,
 40 + (o_orderkey*31) % 400 AS r0
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "vert": """SELECT p.poly_id, cast(d.k AS bigint) AS k, p.cx + d.ux*(p.r0 + (p.poly_id*13 + d.k*29) % 60) AS x, p.cy + d.uy*(p.r0 + (p.poly_id*13 + d.k*29) % 60) AS y
FROM poly p CROSS JOIN (SELECT cast(k AS bigint) AS k, cast(ux AS double) AS ux, cast(uy AS double) AS uy FROM (VALUES (0,1.0,0.0),(1,0.75,0.75),(2,0.0,1.0),(3,-0.75,0.75),(4,-1.0,0.0),(5,-0.75,-0.75),(6,0.0,-1.0),(7,0.75,-0.75)) AS t(k,ux,uy)) d""",
    "tiles": """SELECT p_partkey AS tile_id, CASE WHEN p_partkey % 7 IN (2,5) THEN 'negative' ELSE 'damage' END AS role,
 cast(180 + (p_partkey*53) % 1320 AS double) AS window_m, p_partkey % 5 AS region_id, p_brand AS dca,
 42 + cast((p_partkey*37) % 400 AS double)/100 AS lat, -124 + cast((p_partkey*91) % 700 AS double)/100 AS lon, p_partkey - p_partkey % 4 AS source_id FROM part""",
    "pixels": """SELECT t.tile_id, y.i AS y, x.i AS x,
 CASE WHEN t.tile_id % 50 = 7 THEN 254 ELSE cast((t.tile_id*17 + y.i*31 + x.i*7) % 256 AS int) END AS r, CASE WHEN t.tile_id % 50 = 7 THEN 254 ELSE cast((t.tile_id*29 + y.i*11 + x.i*23) % 256 AS int) END AS g,
 CASE WHEN t.tile_id % 50 = 7 THEN 254 ELSE cast((t.tile_id*5 + y.i*3 + x.i*13) % 256 AS int) END AS b, cast((t.tile_id*41 + y.i*19 + x.i*37) % 256 AS int) AS nir,
 t.role='damage' AND (y.i-8)*(y.i-8)+(x.i-8)*(x.i-8) <= 4 + t.tile_id % 30 AS gt,
 (y.i-8-t.tile_id%5)*(y.i-8-t.tile_id%5)+(x.i-6)*(x.i-6) <= 9 + t.tile_id % 40 AS prior,
 (y.i < 2 AND t.tile_id % 6 = 0) AS ign,
 cast((t.tile_id*3 + y.i*5 + x.i*11 + CASE WHEN (y.i-7)*(y.i-7)+(x.i-9)*(x.i-9) <= 3 + t.tile_id % 25 THEN 80 ELSE 0 END) % 128 AS double) / CASE WHEN t.tile_id % 9 = 0 THEN cast(512 AS double) ELSE cast(128 AS double) END AS prob
FROM tiles t CROSS JOIN {16} y CROSS JOIN {16} x""",
    "neg_candidates": "SELECT event_id AS cand_id, cast((event_id*7727+31) % 650000 AS double) AS cx, cast((event_id*3571+17) % 520000 AS double) AS cy FROM events",
    "survey_regions": """SELECT cast(region_id AS bigint) AS region_id, kind, cast(k AS bigint) AS k, cast(x AS double) AS x, cast(y AS double) AS y FROM (VALUES
 (1,'surveyed',0,0,0),(1,'surveyed',1,420000,0),(1,'surveyed',2,420000,300000),(1,'surveyed',3,200000,360000),(1,'surveyed',4,0,300000),
 (2,'surveyed',0,430000,150000),(2,'surveyed',1,650000,150000),(2,'surveyed',2,650000,520000),(2,'surveyed',3,430000,520000),
 (3,'not_flown',0,100000,100000),(3,'not_flown',1,160000,100000),(3,'not_flown',2,160000,160000),(3,'not_flown',3,100000,160000)) AS t(region_id,kind,k,x,y)""",
    "annotations": """SELECT event_id AS ann_id, event_id % 500 AS tile_id, CASE WHEN event_id % 4 = 0 THEN '5.5.0' ELSE '6.3.1' END AS version,
 CASE event_id % 8 WHEN 0 THEN 'damage' WHEN 1 THEN 'Damage ' WHEN 2 THEN 'prior' WHEN 3 THEN 'ignore' WHEN 4 THEN 'unsure' WHEN 5 THEN 'reject' WHEN 6 THEN 'clean' ELSE 'damage' END AS label,
 CASE event_id % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'rectangle' ELSE 'circle' END AS shape_type,
 CASE WHEN event_id % 3 = 0 THEN concat('[[', cast(event_id % 7 AS string), ',1],[13,', cast(event_id % 5 AS string), '],[11,12],[3,', cast(9 + event_id % 5 AS string), ']]')
      ELSE concat('[[', cast(2 + event_id % 6 AS string), ',', cast(3 + event_id % 4 AS string), '],[', cast(9 + event_id % 6 AS string), ',', cast(8 + event_id % 7 AS string), ']]') END AS points_json FROM events""",
    "epochs": """SELECT f.n_nationkey AS fold, cast(e.i AS bigint) + 1 AS epoch, 1.0e0/(e.i+2) + ((f.n_nationkey*7+e.i*13) % 10)/cast(100 AS double) AS loss,
 (100 + e.i*6 - (e.i*e.i)/cast(20 AS double) + (f.n_nationkey*11+e.i*17) % 9)/cast(1000 AS double) AS inner_iou FROM nation f CROSS JOIN {60} e WHERE f.n_nationkey < 5""",
    "runs": """SELECT o_orderkey AS run_id, concat('v', cast(o_custkey % 6 AS string)) AS train_ver, 100 + 10*(o_custkey % 3) AS n_damage, 60 AS n_negative, o_custkey % 2 = 0 AS grouped_cv,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast((o_orderkey*37) % 200 AS double)/cast(1000 AS double) END AS iou FROM orders""",
    "affine_pairs": """SELECT c_custkey AS pair_id, c_custkey % 4 AS regime, 1 + cast(c_custkey % 9 - 4 AS double)/100 AS ga, cast(c_custkey % 7 - 3 AS double)/100 AS gb, cast(c_custkey % 13 - 6 AS double)/50 AS gtx,
 cast(c_custkey % 5 - 2 AS double)/100 AS gc, 1 + cast(c_custkey % 11 - 5 AS double)/100 AS gd, cast(c_custkey % 17 - 8 AS double)/50 AS gty,
 1 + cast(c_custkey % 10 - 4 AS double)/110 AS pa, cast(c_custkey % 7 - 2 AS double)/110 AS pb, cast(c_custkey % 12 - 6 AS double)/55 AS ptx,
 cast(c_custkey % 5 - 1 AS double)/110 AS pc, 1 + cast(c_custkey % 12 - 5 AS double)/110 AS pd, cast(c_custkey % 16 - 8 AS double)/55 AS pty FROM customer""",
    "patch_boxes": """SELECT l_partkey AS tile_id, l_linenumber % 4 AS patch_row, l_suppkey % 4 AS patch_col, cast(l_orderkey % 300 AS bigint) AS xmin, cast(l_suppkey*3 % 300 AS bigint) AS ymin,
 l_orderkey % 300 + 20 + l_linenumber*3 AS xmax, l_suppkey*3 % 300 + 15 + l_linenumber*4 AS ymax, cast(l_orderkey % 100 AS double)/100 AS score FROM lineitem""",
    "survey_pairs": """SELECT o_orderkey AS damage_area_id, CASE o_orderkey % 5 WHEN 0 THEN 'Reshape' WHEN 1 THEN 'Resahpe' ELSE 'Keep' END AS checked, CASE WHEN o_orderkey % 3 = 0 THEN 'Reshape' ELSE 'None' END AS transform,
 cast((o_orderkey*41) % 300 - 150 AS double) AS dx, cast((o_orderkey*59) % 300 - 150 AS double) AS dy, cast(1 + o_orderkey % 3 AS double)/2 AS s FROM orders""",
    "buckets": """SELECT p_partkey AS tile_id, CASE p_partkey % 10 WHEN 0 THEN 'delete' WHEN 1 THEN 'risky' WHEN 2 THEN 'no_damage' WHEN 3 THEN 'treecut_ignore' WHEN 4 THEN 'damage_ignore' WHEN 5 THEN 'on_hold' ELSE NULL END AS bucket, p_partkey % 3 <> 0 AS has_mask FROM part""",
}
NEEDS = {"vert": ["poly"], "pixels": ["tiles"]}


def _series(sql: str, spark: bool) -> str:
    for n in (16, 60):
        sql = sql.replace(f"{{{n}}}", f"(SELECT {'id' if spark else 'range'} AS i FROM range({n}))")
    return sql


def ctes(*names: str, spark: bool = False) -> str:
    """Common table expressions for the views and those that they need, without WITH."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    return ",\n".join(f"{n} AS ({_series(VIEWS[n], spark)})" for n in order)


#: Tiles of a part, 256 pixels each.
TILES = 2048


class Views:
    """The views and given tables of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        """A view or table. Tiles are dealt out before they are spread into pixels, so that what goes by tile needs no shuffle of pixels.

        The more tiles, the more parts, so that a task's pixels stay as many; operators deal out pixels alike (``standmap.parts``).
        """
        if name in VIEWS:
            given = ", ".join(f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in TABLES if any(t in VIEWS[n] for n in (*NEEDS.get(name, []), name)))
            views = ctes(name, spark=True)
            if name in ("tiles", "pixels"):
                tiles = self.spark.read.parquet(f"{self.sf_dir}/part.parquet").count()  # from the file's footer
                parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-tiles // TILES))
                self.spark.conf.set("standmap.parts", str(parts))
            if name == "pixels":
                dealt = f"/*+ REPARTITION({parts}, tile_id) */"
                views = views.replace("tiles AS (SELECT ", f"tiles AS (SELECT {dealt} ", 1)
            return self.spark.sql(f"WITH {given}{', ' if given else ''}{views} SELECT * FROM {name}")
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
