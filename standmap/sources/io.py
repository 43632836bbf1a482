"""Reading and writing the survey's files with Spark's own sources."""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standmap.operators.blocks import STRIP, new_groups, whole
from standmap.sources.store import dealt, materialize, row_numbers

INDEX = "tile_id string, role string, window_m double, region_id bigint, dca string, lat double, lon double, source_id bigint"
SHAPE = "struct<label:string,shape_type:string,points:array<array<double>>>"
DOCUMENT = f"version string, imagePath string, imageHeight int, imageWidth int, shapes array<{SHAPE}>"


def padded(id_: Column | str, width: int = 4) -> Column:
    """A zero-padded id; longer ids stay whole."""
    c = (F.col(id_) if isinstance(id_, str) else id_).cast("string")
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit("0"))


def read_features(spark: SparkSession, path: str, schema: str, id_col: str = "observation_id", geometry: str = "cx") -> DataFrame:
    """A feature layer from JSON: rows without geometry go, ids lose their braces."""
    return spark.read.schema(schema).json(path).where(F.col(geometry).isNotNull()).withColumn(id_col, F.btrim(id_col, F.lit("{}")))


def read_tile_index(spark: SparkSession, path: str, schema: str = INDEX) -> DataFrame:
    """An index from CSV with its schema; ids are padded again and a missing role is damage."""
    out = spark.read.schema(schema).option("header", True).csv(path)
    return out.withColumn("tile_id", padded("tile_id")).withColumn("role", F.coalesce("role", F.lit("damage")))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shape of annotation documents, one document a line; ``tile_id`` comes from the image's name."""
    docs = spark.read.schema(DOCUMENT).json(path)
    out = docs.select("version", F.regexp_extract("imagePath", r"([^/]+)\.\w+$", 1).alias("tile_id"), F.posexplode("shapes").alias("shape_no", "s"))
    return out.select("tile_id", "version", "shape_no", "s.label", "s.shape_type", "s.points")


def draft_documents(polys: DataFrame, existing: DataFrame | None, version: str = "5.5.0") -> DataFrame:
    """(tile_id, value): a JSON document for each tile of ``polys`` (tile_id, shape_no, label, points, height, width) that has none yet."""
    if existing is not None:
        polys = polys.join(existing.select("tile_id"), "tile_id", "left_anti")
    shape = F.struct("shape_no", "label", F.lit("polygon").alias("shape_type"), "points")
    docs = polys.groupBy("tile_id").agg(F.array_sort(F.collect_list(shape)).alias("shapes"), F.max("height").alias("height"), F.max("width").alias("width"))  # a tile's shapes
    document = F.struct(
        F.lit(version).alias("version"), F.concat(padded("tile_id"), F.lit(".png")).alias("imagePath"), F.col("height").alias("imageHeight"), F.col("width").alias("imageWidth"),
        F.transform("shapes", lambda s: F.struct(s["label"].alias("label"), s["shape_type"].alias("shape_type"), s["points"].alias("points"))).alias("shapes"),
    )
    return docs.select("tile_id", F.to_json(document).alias("value"))


def write_draft_annotations(polys: DataFrame, existing: DataFrame | None, path: str) -> None:
    draft_documents(polys, existing).select("value").write.text(path)


def append_index(prev: DataFrame, new: DataFrame, order: Sequence[str], start_id: int | None = None, id_: str = "tile_id") -> DataFrame:
    """Both tables' rows; new ones are numbered after the highest id, and columns that a table lacks are null."""
    start = start_id if start_id is not None else (prev.agg(F.max(id_)).first()[0] or 0) + 1
    numbered = row_numbers(new.drop(id_), list(order)).withColumn(id_, F.col("rn") + start - 1).drop("rn")
    return prev.unionByName(numbered, allowMissingColumns=True)


def quantised(prob: Column | str) -> Column:
    """A probability, cut to [0, 1], in 8 bits; null stays null."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.floor(F.when(p.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))) * 255).cast("int")


def _folder(spark: SparkSession, path: str):
    """The folder's file system and path, for what only the driver does."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def prediction_checkpoint(px: DataFrame, scores: DataFrame, path: str) -> None:
    """Store the folds of ``px`` (fold, tile_id, prob, ...) and ``scores`` (fold, tile_id, and metrics and thresholds) below ``path``.

    Predictions keep 8 bits. A fold that is stored already is replaced, others stay. Its marker goes first and comes back
    last, when both tables are whole, so that a reader sees a fold whole or not at all. Tables without rows store nothing.
    """
    spark = px.sparkSession
    folds = [r.fold for r in px.select("fold").unionByName(scores.select("fold")).distinct().collect()]  # a row per fold
    for fold in folds:
        fs, at = _folder(spark, f"{path}/done/fold={fold}")
        fs.delete(at, True)
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(f"{path}/{name}")
    put(px.withColumn("q", quantised("prob").cast("short")).drop("prob"), "predictions")
    put(scores, "scores")
    if folds:
        put(spark.createDataFrame([(f, True) for f in folds], T.StructType([px.schema["fold"], T.StructField("whole", T.BooleanType())])), "done")


def _finished(spark: SparkSession, path: str) -> DataFrame | None:
    fs, at = _folder(spark, f"{path}/done")
    held = fs.exists(at) and any(f.getPath().getName().startswith("fold=") for f in fs.listStatus(at))
    return spark.read.parquet(f"{path}/done").select("fold") if held else None


def unfinished_folds(folds: DataFrame, path: str) -> DataFrame:
    """Of ``folds`` (fold) those that aren't stored whole below ``path``: what an interrupted run has left to do."""
    done = _finished(folds.sparkSession, path)
    return folds if done is None else folds.join(F.broadcast(done), "fold", "left_anti")  # a row per fold


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Predictions (..., q) and scores of the folds that are stored whole; raises if none is."""
    done = _finished(spark, path)
    if done is None:
        raise FileNotFoundError(f"no whole fold below {path}")
    return tuple(spark.read.parquet(f"{path}/{t}").join(F.broadcast(done), "fold", "left_semi") for t in ("predictions", "scores"))  # a row per fold


def dataset_fingerprint(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, n, digest): an order-independent digest of all rows of a group: sums of parts of each row's hash.

    Sums combine before the shuffle, so no task holds a group.
    """
    h = F.sha1(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).cast("binary"))
    part = lambda lo: F.sum(F.conv(F.substring(h, lo, 10), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), part(1).cast("string").alias("digest_a"), part(11).cast("string").alias("digest_b"))


def presence_guard(manifest: DataFrame, present: DataFrame, max_missing: float = 0.02, fail: bool = True) -> DataFrame:
    """(n, missing, ratio, ok) of manifest tiles without raster; raises if too many are missing and ``fail`` is set."""
    p = present.select("tile_id", F.lit(1).alias("__p")).distinct()
    out = manifest.join(p, "tile_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__p").isNull()).alias("missing"))
    out = out.withColumn("ratio", F.col("missing") / F.col("n")).withColumn("ok", F.coalesce(F.col("missing") / F.col("n"), F.lit(0.0)) <= max_missing)
    if not fail:
        return out
    r = out.first()  # the one row, so that the join runs once
    if not r["ok"]:
        raise ValueError(f"{r['missing']} of {r['n']} rasters are missing")
    return manifest.sparkSession.createDataFrame([r], out.schema)


def request_plan(tiles: DataFrame, bands: str = "0,1,2,3", cap_px: int = 4000) -> DataFrame:
    """The image requests of tiles (tile_id, xmin, ymin, xmax, ymax, size_px): box text, size below the cap, bands, format."""
    box = F.concat_ws(",", *(F.format_string("%.1f", F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")))
    px = F.least("size_px", F.lit(cap_px))
    return tiles.select("tile_id", box.alias("bbox"), F.concat_ws(",", px.cast("string"), px.cast("string")).alias("size"), F.lit(bands).alias("bands"), F.lit("tiff").alias("format"), (F.col("size_px") > cap_px).alias("capped"))


#: Layers of the pixel table: a picture of three bands, a band, or a flag as 0 and 255.
LAYERS = {"images": ("r", "g", "b"), "masks": ("gt",), "priors": ("prior",), "ignore": ("ign",), "nir": ("nir",)}
FLAGS = ("masks", "priors", "ignore")


def _png(bands: np.ndarray) -> bytes:
    """A PNG file of bytes (height, width, 1 or 3)."""
    height, width, n = bands.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), bands.reshape(height, width * n)], axis=1)  # a line begins with its filter: none
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if n == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def write_raster_layers(px: DataFrame, root: str, layers: Sequence[str] = tuple(LAYERS)) -> DataFrame:
    """Write PNG files ``root/{layer}/{tile_id}.png`` and return (tile_id, layer, bytes) of those written.

    Pixels that a tile lacks are 0, a band that is null all over a tile has no file. A file is one tile's layer, so a
    task holds whole rasters, many small ones together. ``root`` is a folder that all executors reach: a shared path, or
    a URI of a store that Arrow knows. Files are written under another name and moved, so that a repeated task leaves whole files.
    """
    kind = dict(px.dtypes)["tile_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = (pa_fs.LocalFileSystem(), root) if root.startswith("/") else pa_fs.FileSystem.from_uri(root)
        for table in whole(batches, ["tile_id"]):
            first = np.flatnonzero(new_groups(table, ["tile_id"]))
            tiles, y, x = table.column("tile_id").take(pa.array(first)), table.column("y").to_numpy(), table.column("x").to_numpy()
            known = {c: ~pc.is_null(table.column(c), nan_is_null=True).to_numpy() for n in layers for c in LAYERS[n]}
            value = {c: np.where(k, pc.fill_null(table.column(c), False if pa.types.is_boolean(table.column(c).type) else 0).to_numpy(), 0) for c, k in known.items()}
            made = []
            for tile, lo, hi in zip(tiles.to_pylist(), first, np.append(first[1:], table.num_rows), strict=True):
                ty, tx = y[lo:hi], x[lo:hi]
                for layer in layers:
                    bands = LAYERS[layer]
                    if not any(known[c][lo:hi].any() for c in bands):
                        continue
                    out = np.zeros((int(ty.max()) + 1, int(tx.max()) + 1, len(bands)), np.uint8)
                    for i, c in enumerate(bands):
                        v = value[c][lo:hi]
                        out[ty, tx, i] = v.astype(bool) * 255 if layer in FLAGS else v.astype(np.uint8)
                    data, name = _png(out), f"{top}/{layer}/{tile}.png"
                    part = f"{top}/{layer}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as f:
                        f.write(data)
                    store.move(part, name)
                    made.append((tile, layer, len(data)))
            ids = pa.array([m[0] for m in made], tiles.type)
            yield pa.RecordBatch.from_arrays([ids, pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int64())], ["tile_id", "layer", "bytes"])

    here, top = (pa_fs.LocalFileSystem(), root) if root.startswith("/") else pa_fs.FileSystem.from_uri(root)
    for layer in layers:
        here.create_dir(f"{top}/{layer}", recursive=True)
    columns = ["tile_id", "y", "x", *(c for n in layers for c in LAYERS[n])]
    return materialize(dealt(px.select(*columns), "tile_id").sortWithinPartitions("tile_id").mapInArrow(write, f"tile_id {kind}, layer string, bytes long"), "written")


def read_raster_layers(spark: SparkSession, root: str, layers: Sequence[str] = ("images", "masks", "priors", "ignore", "nir")) -> DataFrame:
    """Pixels (tile_id, y, x, r, g, b, gt, prior, ign, nir) of PNG layers below ``root``; the tile id is the file's stem.

    An absent layer is false (nir: null). Spark's image source gives rows of bytes in blue, green, red order. Lines of a
    tile's layers meet as bytes, some at a time, and are spread into pixels there, so that no pixels are joined.
    """
    strips = None
    for i, layer in enumerate(layers):
        raw = spark.read.format("image").option("dropInvalid", True).load(f"{root}/{layer}").select("image.*")
        stem = F.url_decode(F.replace(F.regexp_extract("origin", r"([^/]+)\.\w+$", 1), F.lit("+"), F.lit("%2B")))  # the origin is a URI
        size = F.col("width") * F.col("nChannels")
        cut = raw.where("height > 0 and width > 0").select(stem.alias("tile_id"), "width", "nChannels", "data", size.alias("__s"), F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(STRIP))).alias("y"))
        one = cut.select("tile_id", "y", F.lit(i).alias("layer"), "width", "nChannels", F.expr(f"substring(data, y * __s + 1, {STRIP} * __s)").alias("data"))
        strips = one if strips is None else strips.unionByName(one)
    kinds = ", ".join(f"{c} {'boolean' if n in FLAGS else 'int'}" for n in layers for c in LAYERS[n])
    rows = dealt(strips, "tile_id", "y").sortWithinPartitions("tile_id", "y", "layer")
    out = rows.mapInArrow(lambda batches: _pixels(batches, layers), f"tile_id string, y int, x int, {kinds}")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("gt", "prior", "ign") if c in out.columns})


def _pixels(batches: Iterator[pa.RecordBatch], layers: Sequence[str], together: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """One row for each pixel of the first layer, with the others' values there, of sorted strips (tile id, first line, layer, width, channels, bytes); a flag is a first channel above 128."""
    names = [c for n in layers for c in LAYERS[n]]
    held: list[tuple[str, int, list[np.ndarray | None]]] = []

    def spread() -> pa.RecordBatch:
        shapes = [found[0].shape for _, _, found in held]
        sizes = [h * w for h, w, _ in shapes]
        ids = pa.array([tile for tile, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        columns = [ids, pa.array(np.concatenate([np.repeat(np.arange(y, y + h, dtype=np.int32), w) for (_, y, _), (h, w, _) in zip(held, shapes, strict=True)])), pa.array(np.concatenate([np.tile(np.arange(w, dtype=np.int32), h) for h, w, _ in shapes]))]
        for i, layer in enumerate(layers):
            bands, lack = len(LAYERS[layer]), np.zeros(sum(sizes), bool)
            out = np.zeros((len(lack), 3 if bands == 3 else 1), np.uint8)
            lo = 0
            for (_, _, found), (h, w, _), n in zip(held, shapes, sizes, strict=True):
                v = found[i]
                if v is None:
                    lack[lo : lo + n] = True
                else:
                    v = v[..., [min(c, v.shape[2] - 1) for c in (2, 1, 0)]] if bands == 3 else v[..., :1]
                    if v.shape[:2] == (h, w):
                        out[lo : lo + n] = v.reshape(n, -1)
                    else:
                        th, tw = min(h, v.shape[0]), min(w, v.shape[1])
                        out[lo : lo + n].reshape(h, w, -1)[:th, :tw] = v[:th, :tw]
                        beyond = lack[lo : lo + n].reshape(h, w)
                        beyond[th:], beyond[:, tw:] = True, True
                lo += n
            columns += [pa.array(out[:, c] > 128 if layer in FLAGS else out[:, c].astype(np.int32), mask=lack) for c in range(bands)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["tile_id", "y", "x", *names])

    size, at, found = 0, None, [[] for _ in layers]

    def end() -> int:
        """Files of one name and layer are rows of their own, each with each of other layers; lines without a first layer are none."""
        held.extend((*at, list(one)) for one in itertools.product(*(f or [None] for f in found)) if found[0])
        return sum(f.shape[0] * f.shape[1] for f in found[0])

    for b in batches:
        for tile, y, layer, width, n, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if at != (tile, y):
                size += end() if at else 0
                if size >= together:
                    yield spread()
                    size = 0
                at, found = (tile, y), [[] for _ in layers]
            found[layer].append(np.frombuffer(data, np.uint8).reshape(-1, width, n))
    if at:
        end()
    if held:
        yield spread()


def tile_metrics_table(*per_tile: DataFrame) -> DataFrame:
    """Per-tile results joined into one table; tiles that a result lacks have nulls."""
    out = per_tile[0]
    for t in per_tile[1:]:
        out = out.join(t, "tile_id", "full")
    return out
