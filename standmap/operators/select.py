"""Filters, joins of tables, ordering, sampling and set operations. Everything is lazy but ``interleave`` numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from standmap.sources.store import row_numbers

#: The survey's five levels, easiest last.
SEVERITY = {"Very Severe (>50%)": 0, "Severe (30-50%)": 1, "Moderate (11-29%)": 2, "Light (4-10%)": 3, "Very Light (1-3%)": 4}
UNKNOWN_SEVERITY = 9


def seeded(id_: str | Column, seed: int) -> Column:
    """The shared pseudo-random order of integer ids; ties are broken by the id."""
    c = F.col(id_) if isinstance(id_, str) else id_
    return (c * 7919 + seed * 104729) % 1000003


# --- filters ---------------------------------------------------------------------------------------------------


def filter_funnel(feat: DataFrame, stages: Sequence[tuple[str, Column | None]]) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows that pass all predicates, and the rows left after each stage, in one scan."""
    stages = [(n, F.lit(True) if c is None else F.coalesce(c, F.lit(False))) for n, c in stages]
    all_, sums = F.lit(True), []
    for i, (_, c) in enumerate(stages):
        all_ = all_ & c
        sums.append(F.count_if(all_).alias(f"s{i}"))
    row = feat.agg(F.count(F.lit(1)).alias("n"), *sums)
    items = [F.struct(F.lit(0).alias("stage"), F.lit("all").alias("name"), F.col("n").alias("rows"))]
    items += [F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("name"), F.col(f"s{i}").alias("rows")) for i, (n, _) in enumerate(stages)]
    return feat.where(all_), row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def blank_tile_guard(px: DataFrame, min_std: float = 3, max_white: float = 0.6, white: int = 250) -> DataFrame:
    """(tile_id, std, white, ok): std over all bands together, near-white pixels over all bands."""
    bands = F.array("r", "g", "b")
    s = px.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("s"),
        F.sum(F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")).alias("q"), F.avg((F.array_min(bands) > white).cast("int")).alias("white"),
    )
    mean = F.col("s") / (3 * F.col("n"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / (3 * F.col("n")) - mean * mean))
    return s.select("tile_id", std.alias("std"), "white", ((std >= min_std) & (F.col("white") <= max_white)).alias("ok"))


def mean_range_guard(px: DataFrame, low: float = 5, high: float = 250) -> DataFrame:
    """(tile_id, mean, ok): the variant that drops tiles too dark or too bright on average."""
    mean = F.avg((F.col("r") + F.col("g") + F.col("b")) / 3)
    return px.groupBy("tile_id").agg(mean.alias("mean")).withColumn("ok", F.col("mean").between(low, high))


def draft_guard(docs: DataFrame, masks: DataFrame, draft_version: str = "5.5.0") -> DataFrame:
    """(tile_id, draft, stale_mask): untouched drafts by version alone; their masks, if any, must go."""
    d = docs.groupBy("tile_id").agg(F.bool_and(F.coalesce(F.col("version") == draft_version, F.lit(False))).alias("draft"))
    m = masks.select("tile_id", F.lit(True).alias("m")).distinct()
    return d.join(m, "tile_id", "left").select("tile_id", "draft", (F.col("draft") & F.col("m").isNotNull()).alias("stale_mask"))


def severity_rank(level: Column | str) -> Column:
    level = F.col(level) if isinstance(level, str) else level
    table = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.try_element_at(table, level), F.lit(UNKNOWN_SEVERITY))


def annotation_queue(index: DataFrame, docs: DataFrame, present: DataFrame, keep: Sequence[str], focus: Sequence[str] | None = None) -> DataFrame:
    """Damage tiles of the severities ``keep`` (and agents ``focus``), not yet reviewed, whose raster is present."""
    out = index.where((F.col("role") == "damage") & F.col("pct_affected").isin(list(keep)))
    if focus:
        out = out.where(F.col("dca").isin(list(focus)))
    return out.join(docs.select("tile_id"), "tile_id", "left_anti").join(present.select("tile_id"), "tile_id", "left_semi")


def review_worklist(index: DataFrame, decided: DataFrame, seen: DataFrame, masks: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Tiles not decided, not seen, and without a damage mask, from id ``start``."""
    out = index.where(F.col("tile_id") >= start)
    for t in (decided, seen, masks):
        out = out.join(t.select("tile_id"), "tile_id", "left_anti")
    return out.orderBy("tile_id").limit(limit) if limit else out.orderBy("tile_id")


def unlabelled_report(tiles: DataFrame, docs: DataFrame) -> DataFrame:
    return tiles.join(docs.select("tile_id"), "tile_id", "left_anti")


# --- joins of tables -------------------------------------------------------------------------------------------


def exclude_known(cand: DataFrame, index: DataFrame, key: str = "observation_id") -> DataFrame:
    return cand.join(index.select(key), key, "left_anti")


def tile_meta_join(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Manifest rows in use with their index row; unmeasured tiles are dropped."""
    return manifest.where("use").drop("use").join(index, "tile_id", "left").na.drop(subset=["window_m"])


def pair_corrections(orig: DataFrame, corr: DataFrame, key: str = "damage_area_id") -> DataFrame:
    """Originals marked as reshaped (as spelt either way) with their reshaped polygon."""
    return orig.where(F.col("checked").isin("Reshape", "Resahpe")).join(corr.where("transform = 'Reshape'"), key)


def link_observations(aligned: DataFrame, original: DataFrame, id_col: str = "notes", key: str = "observation_id") -> DataFrame:
    """``aligned`` with ``outcome``: matched, not found, or no id."""
    known = original.select(F.col(key).alias("__k")).distinct()
    out = aligned.join(known, F.col(id_col) == F.col("__k"), "left")
    return out.withColumn("outcome", F.when(F.coalesce(F.trim(id_col), F.lit("")) == "", "no id").when(F.col("__k").isNull(), "not found").otherwise("matched")).drop("__k")


def metrics_join(metrics: DataFrame, index: DataFrame) -> DataFrame:
    return metrics.join(index, "tile_id", "left")


# --- ordering --------------------------------------------------------------------------------------------------


def candidate_order(feat: DataFrame, mode: str, seed: int = 42, id_: str = "poly_id", area: str = "area_m2", group: str = "dca") -> DataFrame:
    """Rows ordered as ``largest``, ``random`` (seeded), ``diverse`` (round-robin over ``group``) or ``first``."""
    if mode == "largest":
        return feat.orderBy(F.desc(area), id_)
    if mode == "random":
        return feat.orderBy(seeded(id_, seed), id_)
    if mode == "diverse":
        return interleave_groups(feat, group, [F.desc(area), F.col(id_)])
    if mode == "first":
        return feat.orderBy(id_)
    raise ValueError(f"unknown mode {mode}")


def _ranked(feat: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    return feat.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def _turns(feat: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``feat`` with ``name``: 1, 2, ... in ``order`` within each group. Rows are numbered over all groups, so none is a task's alone."""
    rows = row_numbers(feat, [F.col(group), *order], "__n")
    low = rows.groupBy(F.col(group).alias("__g")).agg((F.min("__n") - 1).alias("__low"))
    return rows.join(low, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col("__n") - F.col("__low")).drop("__n", "__g", "__low")


def interleave_groups(feat: DataFrame, group: str, order: Sequence[Column], id_: str = "poly_id", drop_null_groups: bool = False) -> DataFrame:
    """Round-robin across groups in order of first appearance (least id), ``order`` within each; ``turn`` says which round."""
    if drop_null_groups:
        feat = feat.where(F.col(group).isNotNull())
    first = feat.groupBy(F.col(group).alias("__g")).agg(F.min(id_).alias("__first"))
    out = _turns(feat, group, order, "turn").join(first, F.col(group).eqNullSafe(F.col("__g")))
    return out.orderBy("turn", "__first").drop("__g", "__first")


def interleave_nested(feat: DataFrame, outer: str, inner: str, order: Sequence[Column], id_: str = "poly_id") -> DataFrame:
    """Round-robin across ``outer`` groups, smallest first, each of them interleaved by ``inner``; ``turn`` is the round."""
    size = feat.groupBy(F.col(outer).alias("__a")).agg(F.count(F.lit(1)).alias("__n"))
    first = feat.groupBy(F.col(outer).alias("__a"), F.col(inner).alias("__b")).agg(F.min(id_).alias("__first"))
    rows = row_numbers(feat, [F.col(outer), F.col(inner), *order], "__k")
    low = rows.groupBy(F.col(outer).alias("__a"), F.col(inner).alias("__b")).agg((F.min("__k") - 1).alias("__low"))
    both = F.col(outer).eqNullSafe(F.col("__a")) & F.col(inner).eqNullSafe(F.col("__b"))
    out = rows.join(low, both).drop("__a", "__b").join(first, both).withColumn("__i", F.col("__k") - F.col("__low")).drop("__a", "__b", "__k", "__low")
    out = _turns(out, outer, [F.col("__i"), F.col("__first")], "turn")
    out = out.join(size, F.col(outer).eqNullSafe(F.col("__a"))).drop("__a")
    return out.orderBy("turn", "__n", outer).drop("__i", "__first", "__n")


def take_until(ordered: DataFrame, ok: DataFrame, n: int, start_id: int, order: Sequence[Column], key: str = "poly_id") -> DataFrame:
    """The first ``n`` candidates that pass the check, with ``new_id`` from ``start_id`` on."""
    passed = ordered.join(ok.select(key), key, "left_semi").orderBy(*order).limit(n)  # n rows: one task numbers them
    return passed.withColumn("new_id", F.row_number().over(Window.orderBy(*order)) + start_id - 1)


def capped_negatives(crops: DataFrame, ratio: float = 0.41, seed: int = 42, id_: str = "crop_id", source: str = "source_id") -> DataFrame:
    """Negatives, at most ``ratio`` x positives, rounded half to even; if there are more, shuffled and first capped per source.

    The cap is the number wanted by the number of sources, rounded down, and one more, so that every source has a part.
    """
    n = crops.agg(F.count_if(F.col("role") == "damage").alias("p"), F.count_if(F.col("role") == "negative").alias("q"), F.count_distinct(F.when(F.col("role") == "negative", F.col(source))).alias("s")).first()
    want = round(n["p"] * ratio)
    neg = crops.where("role = 'negative'")
    if n["q"] <= want:
        return neg
    neg = neg.withColumn("__o", seeded(id_, seed))
    neg = _ranked(neg, source, [F.col("__o"), F.col(id_)], "__r").where(F.col("__r") <= max(1, want // max(1, n["s"]) + 1))
    return row_numbers(neg, ["__o", id_], "__n").where(F.col("__n") <= want).orderBy("__n").drop("__o", "__r", "__n")


def even_subsample(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """``n`` of the ordered rows at evenly spaced positions, first and last included."""
    total = df.count()
    if n >= total:
        return df
    step = (total - 1) / (n - 1) if n > 1 else 0.0
    at = df.sparkSession.range(n).select((F.bround(F.col("id") * step) + 1).cast("long").alias("rn")).distinct()
    return row_numbers(df, list(order)).join(F.broadcast(at), "rn", "left_semi").drop("rn")  # n rows, as asked for


def ratio_sample(df: DataFrame, label: str, ratio: float = 0.25, seed: int = 42, id_: str = "tile_id") -> DataFrame:
    """All positives and at most ``ratio`` x as many negatives, in seeded order."""
    n = int(df.where(label).count() * ratio)
    neg = row_numbers(df.where(~F.col(label)), [seeded(id_, seed), F.col(id_)], "__n").where(F.col("__n") <= n).drop("__n")
    return df.where(label).unionByName(neg)


def per_class_sample(px: DataFrame, label: str, n: int = 6000, seed: int = 42) -> DataFrame:
    """At most ``n`` pixels per tile and class."""
    at = F.col("y") * 4096 + F.col("x")
    w = Window.partitionBy("tile_id", label).orderBy(seeded(at, seed), "y", "x")
    return px.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def stride_sample(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Every ``n``-th row of the ordered rows, the first included."""
    return row_numbers(df, list(order)).where((F.col("rn") - 1) % n == 0).drop("rn")


def extremes_pages(scores: DataFrame, metric: str, source: str, floods: str, painted: str, n: int = 72, page: int = 36, id_: str = "tile_id") -> DataFrame:
    """``n`` rows of each kind with rank and page: best and worst by ``metric``; those that flood (flag), by source and then best
    first; and those without a metric, which have no label, by their ``painted`` share."""
    known = F.col(metric).isNotNull()
    kinds = {
        "best": (known, [F.desc(metric), F.col(id_)]), "worst": (known, [F.asc(metric), F.col(id_)]),
        "flooded": (known & F.col(floods), [F.asc(source), F.desc(metric), F.col(id_)]), "negative": (~known, [F.desc_nulls_last(painted), F.col(id_)]),
    }
    out = None
    for kind, (rows, order) in kinds.items():
        top = scores.where(rows).orderBy(*order).limit(n)  # n rows: one task ranks them
        top = top.withColumn("rn", F.row_number().over(Window.orderBy(*order))).withColumn("kind", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return out.withColumn("page", F.floor((F.col("rn") - 1) / page))


def value_counts(df: DataFrame, by: str, value: str | None = None, category: str | None = None) -> DataFrame:
    """(by, n), with mean, low and high of ``value``, and ``mode``, the most frequent ``category`` (the least of equals)."""
    spread = [F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")] if value else []
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *spread)
    if not category:
        return out
    k = df.groupBy(by, category).agg(F.count(F.lit(1)).alias("k"))  # counts first, so that no group is gathered
    mode = k.groupBy(F.col(by).alias("__g")).agg(F.min(F.struct((-F.col("k")).alias("k"), F.col(category).alias("c"))).getField("c").alias("mode"))
    return out.join(mode, F.col(by).eqNullSafe(F.col("__g"))).drop("__g")


def queue_counts(queue: DataFrame, by: str = "dca") -> DataFrame:
    """(agent, n): how many tiles of a queue an agent has, the most first; unknown agents are ``?``."""
    return queue.groupBy(F.coalesce(by, F.lit("?")).alias(by)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


# --- sets of tile ids ------------------------------------------------------------------------------------------


def apply_verdicts(delete: DataFrame, no_damage: DataFrame, reject: DataFrame, clean: DataFrame, damage: DataFrame) -> DataFrame:
    """(list, tile_id): delete = (delete + reject) - clean - damage; no_damage = (no_damage + clean) - reject - damage."""
    t = [x.select("tile_id") for x in (delete, no_damage, reject, clean, damage)]
    d = t[0].union(t[2]).distinct().subtract(t[3]).subtract(t[4])
    n = t[1].union(t[3]).distinct().subtract(t[2]).subtract(t[4])
    return d.select(F.lit("delete").alias("list"), "tile_id").union(n.select(F.lit("no_damage").alias("list"), "tile_id"))


def bucket_clash(buckets: DataFrame, touched: DataFrame) -> DataFrame:
    """Ids that verdicts touch and that sit in a bucket as well."""
    return touched.select("tile_id").intersect(buckets.where("bucket is not null").select("tile_id"))


def seen_set(seen: DataFrame, new: DataFrame) -> DataFrame:
    return seen.select("tile_id").union(new.select("tile_id")).distinct()
