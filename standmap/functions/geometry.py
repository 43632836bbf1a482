"""Geometry as column math: projections, measures, windows, pixels and affine maps of vertex tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Lambert:
    """Lambert conformal conic with two parallels; lengths in ``unit_m`` metres. Defaults: fixed values of Oregon's."""

    lat1: float = 43.0
    lat2: float = 45.5
    lat0: float = 41.75
    lon0: float = -120.5
    x0_m: float = 400000.0
    y0_m: float = 0.0
    a: float = 6378137.0
    inverse_flattening: float = 298.257222101
    unit_m: float = 1.0

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(2 * f - f * f)

    def _m(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - (self.e * s) ** 2)

    def _t(self, lat: float) -> float:
        p, s = math.radians(lat), self.e * math.sin(math.radians(lat))
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    @property
    def constants(self) -> tuple[float, float, float]:
        """Cone constant, scale and the radius at the origin."""
        n = (math.log(self._m(self.lat1)) - math.log(self._m(self.lat2))) / (math.log(self._t(self.lat1)) - math.log(self._t(self.lat2)))
        f = self._m(self.lat1) / (n * self._t(self.lat1) ** n)
        return n, f, self.a * f * self._t(self.lat0) ** n


def to_lambert(lon: Column, lat: Column, p: Lambert = Lambert()) -> tuple[Column, Column]:
    n, f, r0 = p.constants
    phi = F.radians(lat)
    s = p.e * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(p.e / 2))
    r, theta = p.a * f * F.pow(t, F.lit(n)), n * F.radians(lon - p.lon0)
    return (p.x0_m + r * F.sin(theta)) / p.unit_m, (p.y0_m + r0 - r * F.cos(theta)) / p.unit_m


def from_lambert(x: Column, y: Column, p: Lambert = Lambert(), rounds: int = 5) -> tuple[Column, Column]:
    n, f, r0 = p.constants
    dx, dy = x * p.unit_m - p.x0_m, r0 - (y * p.unit_m - p.y0_m)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (p.a * f), F.lit(1 / n))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(rounds):
        s = p.e * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(p.e / 2)))
    return F.degrees(F.atan2(dx, dy)) / n + p.lon0, F.degrees(phi)


def reproject(df: DataFrame, to: str, p: Lambert = Lambert(), columns: tuple[str, str, str, str] = ("lon", "lat", "x", "y")) -> DataFrame:
    """``df`` with x, y from lon, lat (``to='lambert'``) or the other way (``to='wgs84'``). A ``crs`` column must be of one kind."""
    lon, lat, x, y = columns
    a, b = to_lambert(F.col(lon), F.col(lat), p) if to == "lambert" else from_lambert(F.col(x), F.col(y), p)
    return df.withColumns({x: a, y: b} if to == "lambert" else {lon: a, lat: b})


def polygon_measures(vert: DataFrame, id_: str = "poly_id", ring: str | None = None) -> DataFrame:
    """(id, area_m2, xmin, ymin, xmax, ymax, extent_m, cx, cy) by the shoelace rule; holes wind the other way."""
    keys = [id_, *([ring] if ring else [])]
    w = Window.partitionBy(*keys).orderBy("k")
    first = Window.partitionBy(*keys)
    v = vert.withColumn("nx", F.coalesce(F.lead("x").over(w), F.min_by("x", "k").over(first))).withColumn("ny", F.coalesce(F.lead("y").over(w), F.min_by("y", "k").over(first)))
    c = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    s = v.groupBy(id_).agg(
        F.sum(c).alias("c"), F.sum((F.col("x") + F.col("nx")) * c).alias("sx"), F.sum((F.col("y") + F.col("ny")) * c).alias("sy"),
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"),
    )
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return s.select(id_, F.abs(F.col("c") / 2).alias("area_m2"), "xmin", "ymin", "xmax", "ymax", extent.alias("extent_m"), (F.col("sx") / (3 * F.col("c"))).alias("cx"), (F.col("sy") / (3 * F.col("c"))).alias("cy"))


def window_and_size(feat: DataFrame, gsd: float = 0.30, pad: float = 0.25, min_m: float = 180, max_m: float = 1500, px: tuple[int, int] = (512, 2048)) -> DataFrame:
    """``feat`` with window_m (null beyond ``max_m``), size_px and gsd_m; rounding is half to even."""
    want = F.greatest(F.col("extent_m") * (1 + 2 * pad), F.lit(float(min_m)))
    window = F.when(want <= max_m, want)
    size = F.least(F.greatest(F.bround(window / gsd).cast("int"), F.lit(px[0])), F.lit(px[1]))
    size = F.when(window.isNotNull(), size)
    return feat.withColumns({"window_m": window, "size_px": size, "gsd_m": window / size})


def square_bbox(feat: DataFrame, side_col: str = "window_m", mode: str = "centroid", pad: float = 0.3) -> DataFrame:
    """xmin, ymin, xmax, ymax of a square: around the centroid, around the box of a pair (padded), or 1.3 x the extent."""
    if mode == "centroid":
        cx, cy, half = F.col("cx"), F.col("cy"), F.col(side_col) / 2
    elif mode == "extent":
        cx, cy, half = F.col("cx"), F.col("cy"), F.col(side_col) * 1.3 / 2
    elif mode == "pair":
        lo = {a: F.least(f"a_{a}min", f"b_{a}min") for a in "xy"}
        hi = {a: F.greatest(f"a_{a}max", f"b_{a}max") for a in "xy"}
        cx, cy = (lo["x"] + hi["x"]) / 2, (lo["y"] + hi["y"]) / 2
        half = F.greatest(hi["x"] - lo["x"], hi["y"] - lo["y"]) * (1 + pad) / 2
    else:
        raise ValueError(f"unknown mode {mode}")
    return feat.withColumns({"xmin": cx - half, "ymin": cy - half, "xmax": cx + half, "ymax": cy + half})


def geo_to_pixel(vert: DataFrame, inverse: bool = False) -> DataFrame:
    """Pixels px, py of x, y in a north-up tile (xmin, ymax, gsd_m), or the other way."""
    if inverse:
        return vert.withColumns({"x": F.col("xmin") + F.col("px") * F.col("gsd_m"), "y": F.col("ymax") - F.col("py") * F.col("gsd_m")})
    return vert.withColumns({"px": (F.col("x") - F.col("xmin")) / F.col("gsd_m"), "py": (F.col("ymax") - F.col("y")) / F.col("gsd_m")})


def affine_polygon(vert: DataFrame, params: DataFrame, id_: str = "poly_id", origin: str = "centroid") -> DataFrame:
    """Vertices under x' = a x + b y + tx, y' = c x + d y + ty (``params``: id, a, b, tx, c, d, ty), about the vertex mean or 0."""
    v = vert.join(params, id_)
    if origin == "centroid":
        w = Window.partitionBy(id_)
        v = v.withColumns({"__ox": F.avg("x").over(w), "__oy": F.avg("y").over(w)})
    else:
        v = v.withColumns({"__ox": F.lit(0.0), "__oy": F.lit(0.0)})
    dx, dy = F.col("x") - F.col("__ox"), F.col("y") - F.col("__oy")
    x = F.col("__ox") + F.col("a") * dx + F.col("b") * dy + F.col("tx")
    y = F.col("__oy") + F.col("c") * dx + F.col("d") * dy + F.col("ty")
    return v.select(id_, "k", x.alias("x"), y.alias("y"))


def affine_augment(polys: DataFrame, phases: DataFrame, n: int, seed: int, id_: str = "poly_id") -> DataFrame:
    """``n`` seeded affines per polygon and phase (phase, max_shift, max_turn, max_shear, max_scale): A = R * Sh * S."""
    out = polys.select(id_).crossJoin(F.broadcast(phases)).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # phases: a few rows
    u = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), id_, "phase", "n"), F.lit(1 << 52)) / float(1 << 52) * 2 - 1
    out = out.withColumns({"turn": F.radians(u("turn") * F.col("max_turn")), "shear": F.tan(F.radians(u("shear") * F.col("max_shear"))), "sx": 1 + u("sx") * F.col("max_scale"), "sy": 1 + u("sy") * F.col("max_scale")})
    cos, sin = F.cos("turn"), F.sin("turn")
    return out.select(
        id_, "phase", "n", (cos * F.col("sx")).alias("a"), ((cos * F.col("shear") - sin) * F.col("sy")).alias("b"), (u("tx") * F.col("max_shift")).alias("tx"),
        (sin * F.col("sx")).alias("c"), ((sin * F.col("shear") + cos) * F.col("sy")).alias("d"), (u("ty") * F.col("max_shift")).alias("ty"),
    )
