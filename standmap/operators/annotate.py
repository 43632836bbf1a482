"""Annotation shapes: label taxonomy, polygons, verdicts, the manifest."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINTS = "array<array<double>>"
#: Labels that aren't damage.
LABELS = {"prior": "guide", "ignore": "ignore", "unsure": "ignore", "reject": "reject", "clean": "clean"}


def label_taxonomy(label: Column | str) -> Column:
    """guide, ignore, reject, clean or damage, from the trimmed lower-case label."""
    c = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    table = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit("damage"))


def shape_to_polygon(shape_type: Column, points: Column, circle_n: int = 48) -> Column:
    """Ring of a shape: a polygon of three points or more, a rectangle's corners, a circle as a 48-gon; else null.

    ``points`` is bound once, so that what it is parsed from isn't parsed again for each number of a ring.
    """

    def ring(points: Column) -> Column:
        p = lambda i, j: F.get(F.get(points, F.lit(i)), F.lit(j))
        radius = F.sqrt((p(1, 0) - p(0, 0)) * (p(1, 0) - p(0, 0)) + (p(1, 1) - p(0, 1)) * (p(1, 1) - p(0, 1)))
        turns = [F.lit(2 * math.pi) * k / circle_n for k in range(circle_n)]
        units = F.array(*(F.struct(F.cos(t).alias("c"), F.sin(t).alias("s")) for t in turns))
        size = F.struct(p(0, 0).alias("x"), p(0, 1).alias("y"), radius.alias("r"))
        circle = _bound(size, lambda o: F.transform(units, lambda u: F.array(o["x"] + o["r"] * u["c"], o["y"] + o["r"] * u["s"])))
        corners = F.array(F.array(p(0, 0), p(0, 1)), F.array(p(1, 0), p(0, 1)), F.array(p(1, 0), p(1, 1)), F.array(p(0, 0), p(1, 1)))
        n = F.size(points)
        return F.when((shape_type == "polygon") & (n >= 3), points).when((shape_type == "rectangle") & (n == 2), corners).when((shape_type == "circle") & (n == 2), circle)

    return _bound(points, ring)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def annotation_precedence(docs: DataFrame, source: str, order: Sequence[str], id_: str = "ann_id") -> DataFrame:
    """One document per tile: of the first source in ``order``, then the least id."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    w = Window.partitionBy("tile_id").orderBy(F.when(rank > 0, rank).otherwise(F.lit(len(order) + 1)), id_)
    return docs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def tile_verdict(ann: DataFrame, job: str = "empty", label: str = "label") -> DataFrame:
    """(tile_id, verdict): reject beats damage beats clean, which counts in the job ``empty`` alone; otherwise untouched."""
    kind = label_taxonomy(label)
    has = lambda k: F.bool_or(kind == k)
    verdict = F.when(has("reject"), "reject").when(has("damage"), "damage").when(has("clean") & F.lit(job == "empty"), "clean").otherwise("untouched")
    return ann.groupBy("tile_id").agg(verdict.alias("verdict"))


#: Buckets in the order of their lists, of which a later one wins, and those whose tiles don't enter training.
BUCKETS = ("delete", "risky", "too_small", "no_damage", "treecut_ignore", "damage_ignore", "on_hold")
UNUSED = ("delete", "risky", "too_small", "on_hold")


def build_manifest(tiles: DataFrame, buckets: DataFrame, masks: DataFrame, ignored: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """(tile_id, bucket, has_mask, damage, ignore, role, use, warning) of every tile.

    ``tiles``: tile_id and the index's role. ``buckets``: tile_id and bucket, of which a later list wins. ``masks``:
    tile_id and damage_px of tiles that have a mask. ``ignored``: tiles with an ignore region. ``reviewed``: negatives
    of the index that may be trusted (None: all). Damage pixels decide, not that there is a mask.
    """
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    b = buckets.where("bucket is not null").groupBy("tile_id").agg(F.max_by("bucket", rank).alias("bucket"), F.count_distinct("bucket").alias("__n"))
    out = tiles.select("tile_id", F.col("role").alias("__ix")).join(b, "tile_id", "left").join(masks.select("tile_id", "damage_px"), "tile_id", "left")
    out = out.join(ignored.select("tile_id", F.lit(True).alias("__ign")).distinct(), "tile_id", "left")
    if reviewed is not None:
        out = out.join(reviewed.select("tile_id", F.lit(True).alias("__rev")).distinct(), "tile_id", "left")
    trusted = F.lit(True) if reviewed is None else F.coalesce("__rev", F.lit(False))
    px = F.coalesce("damage_px", F.lit(0))
    out = out.select("tile_id", F.coalesce("bucket", F.lit("(unlisted)")).alias("bucket"), F.col("damage_px").isNotNull().alias("has_mask"), (px > 0).alias("damage"), F.coalesce("__ign", F.lit(False)).alias("ignore"), px.alias("__px"), F.coalesce("__ix", F.lit("")).alias("__ix"), F.coalesce("__n", F.lit(0)).alias("__n"), trusted.alias("__ok"))
    bucket, damage, mask, empty = F.col("bucket"), F.col("damage"), F.col("has_mask"), F.col("__ix") == "negative"
    unused, unlisted = bucket.isin(*UNUSED), bucket == "(unlisted)"
    role = F.when(unused, "exclude").when(bucket == "no_damage", F.when(damage, "damage").otherwise("negative")).when(bucket == "treecut_ignore", F.when(damage, "damage").otherwise("exclude"))
    role = role.when((bucket == "damage_ignore") | damage, "damage").when(empty, F.when(F.col("__ok"), "negative").otherwise("exclude")).when(mask, "exclude").otherwise("skip")
    pixels = lambda text: F.concat(F.lit(text), F.col("__px").cast("string"), F.lit(" damage px"))
    told = F.when((bucket == "no_damage") & damage, pixels("no_damage but ")).when((bucket == "no_damage") & ~mask, "no_damage without a mask").when((bucket == "damage_ignore") & ~damage, "damage_ignore without damage px")
    told = told.when(unlisted & damage & empty, pixels("negative in the index but ")).when(unlisted & ~damage & ~empty & mask, "empty and unlisted")
    warning = F.concat_ws("; ", F.when(F.col("__n") > 1, "several buckets"), told)
    return out.select("tile_id", "bucket", "has_mask", "damage", "ignore", role.alias("role"), role.isin("damage", "negative").alias("use"), warning.alias("warning"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """(damage, negative, ignore, excluded, skipped): tiles in use by role, those with an ignore region, and the rest."""
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return manifest.agg(n("use and role = 'damage'", "damage"), n("use and role = 'negative'", "negative"), n("use and ignore", "ignore"), n("role = 'exclude'", "excluded"), n("role = 'skip'", "skipped"))


def shape_table(ann: DataFrame, points_json: str = "points_json") -> DataFrame:
    """``ann`` with ``points`` parsed, ``kind`` and the polygon ``ring`` (null if the shape has none)."""
    out = ann.withColumn("points", F.from_json(points_json, POINTS))
    return out.withColumn("kind", label_taxonomy("label")).withColumn("ring", shape_to_polygon(F.col("shape_type"), F.col("points")))
