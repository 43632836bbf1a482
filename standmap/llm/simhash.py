"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of eight 8-bit segments. If two fingerprints differ in three bits or fewer, some
segment starts a chain of consecutive segments whose first l segments differ in floor(3 * l / 8) bits at most, for
every l: none in the first two, one in five, two in seven, three in all. Candidates must agree in the first two
segments of a chain and in two of the next three (one bit spoils one segment), which makes 24 keys of 32 bits; the
rest of the chain is checked before the full Hamming distance.

:func:`keep_one` looks wider: texts whose five-word shingles have a Jaccard similarity of 0.8 differ in about eight
bits, so its chains run at twelve (budgets 1, 3, 4, 6 and so on). A first pass over fingerprints alone finds the texts
that have a candidate; only these go on with their shingles, and the exact Jaccard similarity decides. A group is
searched from text to text, so that a text that is joined already isn't compared again and links are fewer than texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standmap.llm.common import free_name, materialize
from standmap.llm.components import components

BITS, SEGMENTS, DISTANCE = 64, 8, 3
#: Near-duplicates of :func:`keep_one`: the bits within which candidates lie, and the shingles and similarity that decide.
WIDE, SHINGLE, SIMILARITY = 12, 5, 0.8
#: Fingerprints of one key that a task compares; larger buckets are cut into blocks, and each pair of blocks compared.
BLOCK = 4096
#: Of the third to fifth segment of a chain, the two that agree.
_PAIRS = ((2, 3), (2, 4), (3, 4))
#: Texts of one size class that a task compares at a wide distance, shingles that it verifies, and pairs or shingles that
#: it looks at together. Larger classes are cut into blocks, and each pair of blocks compared.
WIDE_BLOCK, WIDE_SHINGLES, TOGETHER = 131_072, 2_000_000, 2_000_000


def shingle_hashes(words: list[bytes], size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(r, seed) for r in runs), np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is 1 if it is set in more than half of the shingle hashes. No words: zero."""
    h = shingle_hashes(_words(text), size)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 4096):
        part = np.ascontiguousarray(h[lo : lo + 4096].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long, and Spark's xxhash64 of the text, for every row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    held = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return held.mapInArrow(run, T.StructType([*held.schema.fields[:2], T.StructField("fp", T.LongType())]))


def _ring(start: int) -> str:
    """The fingerprint turned so that segment ``start`` comes first."""
    s = 8 * start
    return f"(shiftleft(fp, {s}) | shiftrightunsigned(fp, {BITS - s}))" if s else "fp"


def chain_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) of distinct fingerprints: the chain's start and kind, and the four segments that must agree."""
    kinds = []
    for start in range(SEGMENTS):
        segment = [f"(shiftrightunsigned({_ring(start)}, {56 - 8 * i}) & 255)" for i in range(5)]
        for k, (i, j) in enumerate(_PAIRS):
            kinds.append(f"shiftleft({start * 3 + k}L, 32) | shiftleft({segment[0]}, 24) | shiftleft({segment[1]}, 16) | shiftleft({segment[i]}, 8) | {segment[j]}")
    return fps.select("fp", F.explode(F.array(*map(F.expr, kinds))).alias("key"))


def close(fp: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which of ``others`` link with ``fp`` by a chain from ``start``: the budget of seven segments first, then all others and the Hamming distance."""
    x = np.bitwise_xor(others, fp)
    turned = x if not start else (x << np.uint64(8 * start)) | (x >> np.uint64(BITS - 8 * start))
    chain = np.flatnonzero(np.bitwise_count(turned >> np.uint64(BITS - 8 * 7)) <= DISTANCE * 7 // SEGMENTS)
    return chain[chained(x[chain], start, DISTANCE)]


def forest(left: np.ndarray, right: np.ndarray | None, start: int) -> Iterator[tuple[int, int]]:
    """Links that join all that is linked within a bucket, or between two blocks: one fewer than nodes at most."""
    fps = left if right is None else np.concatenate((left, right))
    waiting = np.arange(len(fps))
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            hit = close(fps[at], fps[waiting], start)
            if len(hit):
                found = waiting[hit]
                for k in found:
                    yield int(fps[at]), int(fps[k])
                front.extend(found)
                waiting = np.delete(waiting, hit)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fp`` that join all components; not every link of a component is among them."""
    keyed = chain_keys(fps)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(sizes, "key")
    # a bucket beyond BLOCK is dealt to blocks by hash; a block meets every block, itself included, in a task of its own
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mine")

    def run(batches):
        held: list[np.ndarray] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(np.stack([b.column(k).to_numpy() for k in range(5)]))
            if not held:
                continue
            m = np.concatenate(held, axis=1) if len(held) > 1 else held[0]
            edge = np.flatnonzero((np.diff(m[:3], axis=1) != 0).any(axis=0)) + 1
            bounds = [0, *edge.tolist()] + ([m.shape[1]] if b is None else [])
            out: list[tuple[int, int]] = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    g = m[4, lo:hi].view(np.uint64)
                    out += forest(g, None, int(m[0, lo] >> 32) // 3)
            held = [] if b is None else [m[:, bounds[-1] :]]
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of ``docs``.

    Fingerprints link at three differing bits or fewer; ``component_id`` is the least document id that can be reached,
    the row's own included. Texts without words, null ones too, have fingerprint zero and link like any other. Null
    ids are passed over in the minimum; a component of null ids alone has a null id. Equal rows share all values. An
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp")))
    of = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(of.join(roots, "root").select("fp", "component_id", "root"), "named")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of runs of ``size`` words, in order; of the whole sequence if it is shorter; none without words."""
    return np.unique(shingle_hashes(_words(text), size))


def _sized(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, text_hash, fp, n): :func:`fingerprints` with the number of distinct five-word shingles."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), pa.array([len(shingle_set(t)) for t in texts], pa.int64())], ["doc_id", "text_hash", "fp", "n"])

    held = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return held.mapInArrow(run, T.StructType([*held.schema.fields[:2], T.StructField("fp", T.LongType()), T.StructField("n", T.LongType())]))


def chained(x: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether differences ``x`` keep the budget floor(l * distance / 8) in the first l segments from ``start``, for every l."""
    turned = x if not start else (x << np.uint64(8 * start)) | (x >> np.uint64(BITS - 8 * start))
    ok = np.bitwise_count(x) <= distance
    for i in range(1, SEGMENTS):
        ok &= np.bitwise_count(turned >> np.uint64(BITS - 8 * i)) <= distance * i // SEGMENTS
    return ok


def _within(fp: np.ndarray, left: np.ndarray, right: np.ndarray, start: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``left`` and ``right`` (places in ``fp``) with a chain from ``start``; each pair once if both are the same."""
    turned = fp if not start else (fp << np.uint64(8 * start)) | (fp >> np.uint64(BITS - 8 * start))
    segment = (turned >> np.uint64(BITS - 8)).astype(np.int64)
    one = left is right
    by = []
    for side in (left, right):
        side = side[np.argsort(segment[side], kind="stable")]
        by.append((side, np.searchsorted(segment[side], np.arange(257))))
    (ls, lat), (rs, rat) = by
    masks = [m for m in range(256) if m.bit_count() <= distance // SEGMENTS]
    for v in np.flatnonzero(np.diff(lat)).tolist():
        mine = ls[lat[v] : lat[v + 1]]
        others = [rs[rat[v ^ m] : rat[(v ^ m) + 1]] for m in masks if not one or v ^ m >= v]
        other = np.concatenate(others)
        step = max(1, TOGETHER // max(1, len(other)))
        for lo in range(0, len(mine), step):
            a, b = np.nonzero(np.bitwise_count(fp[mine[lo : lo + step], None] ^ fp[other][None, :]) <= distance)
            a, b = mine[lo : lo + step][a], other[b]
            ok = chained(fp[a] ^ fp[b], start, distance)
            if one:
                ok &= (segment[a] != segment[b]) | (a < b)
            yield a[ok], b[ok]


def _dealt(rows: DataFrame, weight: Column, most: int, similarity: float, more: list[str], starts: bool) -> DataFrame:
    """Rows (text_hash, fp, n, ...) as guests and at home in classes ``g`` of like sizes, and in pairs of blocks (i, j).

    A text can be similar to those of its class and the next ones only. A class of more than ``most`` of ``weight`` is
    cut into blocks by hash; with ``starts``, a pair of blocks comes once for each start of a chain.
    """
    width = np.log(1.001 / similarity)
    class_ = F.when(F.col("n") == 0, -2).otherwise(F.floor(F.log("n") / F.lit(float(width)))).cast("long")
    places = F.explode(F.array(*(F.struct((class_ + k).alias("g"), F.lit(k).cast("long").alias("guest")) for k in (0, 1))))
    kept = ["text_hash", "fp", "n", *more]
    rows = rows.select(*kept, places.alias("p")).select(*kept, "p.g", "p.guest")
    sizes = rows.groupBy("g").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("m"), F.count_if(F.col("guest") == 0).alias("homes")).where("homes > 0 and m > 1")
    sizes = sizes.select("g", F.greatest(F.lit(1), F.ceil(F.col("w") / most)).cast("long").alias("blocks"))  # a row for each class
    rows = rows.join(F.broadcast(sizes), "g").withColumn("mine", F.pmod(F.xxhash64("text_hash", F.lit(1)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("start", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SEGMENTS if starts else 1)))))
    keys = ["g", "start", "i", "j"]
    rows = rows.select("g", "start", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "guest", *kept)
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _grouped(batches, keys: int) -> Iterator[pa.Table]:
    """Rows that come sorted by their first ``keys`` columns, in groups of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        m = np.stack([b.column(k).to_numpy() for k in range(keys)])
        edge = [0, *(np.flatnonzero((np.diff(m, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edge, edge[1:], strict=False):
            key = tuple(m[:, lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def wide_candidates(nodes: DataFrame, distance: int = WIDE, similarity: float = SIMILARITY) -> DataFrame:
    """(text_hash): the texts (text_hash, fp, n) that some other one is within ``distance`` bits of, as sizes allow ``similarity``."""

    def run(batches):
        for group in _grouped(batches, 4):
            start, i, j = (group.column(c)[0].as_py() for c in ("start", "i", "j"))
            mine, guest, t, n = (group.column(c).to_numpy() for c in ("mine", "guest", "text_hash", "n"))
            fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            left = np.flatnonzero(mine == i)
            right = left if i == j else np.flatnonzero(mine == j)
            found = np.zeros(len(t), bool)
            for a, b in _within(fp, left, right, start, distance):
                ok = (guest[a] + guest[b] < 2) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])) & (t[a] != t[b])
                found[a[ok]] = found[b[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(t[found])], ["text_hash"])

    return _dealt(nodes, F.lit(1), WIDE_BLOCK, similarity, [], True).mapInArrow(run, "text_hash long").distinct()


def _similar(at: int, others: np.ndarray, n: np.ndarray, ends: np.ndarray, values: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``others`` have a Jaccard similarity of ``similarity`` or more to text ``at``; text k has shingles [ends[k], ends[k + 1])."""
    mine, out = values[ends[at] : ends[at + 1]], []
    for part in np.split(others, np.flatnonzero(np.diff(np.cumsum(n[others]) // TOGETHER)) + 1):
        theirs = np.concatenate([values[:0], *(values[ends[k] : ends[k + 1]] for k in part.tolist())])
        of = np.repeat(np.arange(len(part)), n[part])
        place = np.searchsorted(mine, theirs)
        place[place == len(mine)] = 0
        both = np.bincount(of[mine[place] == theirs] if len(mine) else of[:0], minlength=len(part))
        out.append(part[both >= similarity * (n[at] + n[part] - both)])
    return np.concatenate(out)


def verified_links(nodes: DataFrame, distance: int = WIDE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that join all similar texts of ``nodes`` (text_hash, fp, n, shingles); not every link is among them."""

    def run(batches):
        for group in _grouped(batches, 4):
            guest, t, n = (group.column(c).to_numpy() for c in ("guest", "text_hash", "n"))
            fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            lists = group.column("shingles").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64).view(np.uint64)
            out: list[tuple[int, int]] = []
            waiting = np.arange(len(t))
            while len(waiting):
                front, waiting = [int(waiting[0])], waiting[1:]
                while front and len(waiting):
                    at = front.pop()
                    ok = np.bitwise_count(fp[waiting] ^ fp[at]) <= distance
                    ok &= (guest[waiting] + guest[at] < 2) & (np.minimum(n[waiting], n[at]) >= similarity * np.maximum(n[waiting], n[at]))
                    hit = _similar(at, waiting[ok], n, ends, values, similarity) if ok.any() else waiting[:0]
                    if len(hit):
                        out += [(int(t[at]), int(t[k])) for k in hit.tolist()]
                        front += hit.tolist()
                        waiting = waiting[~np.isin(waiting, hit)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return _dealt(nodes, F.greatest("n", F.lit(1)), WIDE_SHINGLES, similarity, ["shingles"], False).mapInArrow(run, "a long, b long").distinct()


def _with_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(text_hash, fp, n, shingles) of ``texts`` (text_hash, text)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            sets = [shingle_set(t).view(np.int64) for t in texts]
            n = np.array([len(x) for x in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array(n), lists], ["text_hash", "fp", "n", "shingles"])

    return texts.mapInArrow(run, "text_hash long, fp long, n long, shingles array<long>")


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = WIDE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root) for every row: texts of one root are joined by links.

    Texts link if their fingerprints over ``size`` words differ in ``distance`` bits or fewer and the exact Jaccard
    similarity of their five-word shingles is ``similarity`` or more. Texts without words, null ones too, are alike.
    """
    rows = materialize(_sized(docs, doc_id, text, size), "sized")
    near = materialize(wide_candidates(rows.select("text_hash", "fp", "n").distinct(), distance, similarity), "near")
    texts = docs.select(F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")).join(near, "text_hash", "left_semi")
    texts = materialize(_with_shingles(texts.groupBy("text_hash").agg(F.first("text").alias("text")), size), "shingles")
    found = components(verified_links(texts, distance, similarity))
    return rows.join(found, rows.text_hash == found.node, "left").select("doc_id", "text_hash", F.coalesce("component", "text_hash").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, distance: int = WIDE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of :func:`similar_texts`, with its columns as they are: the least id, then the least hash.

    Null ids come last. Rows with equal id and text count as one, of which one row stays.
    """
    place = lambda d, t: F.concat_ws("|", F.col(d).isNull().cast("string"), F.col(d).cast("string"), F.col(t).cast("string"))
    groups = materialize(similar_texts(docs, doc_id, text, size, distance, similarity), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    key, hash_ = free_name(docs, "key"), free_name(docs, "hash")
    rows = materialize(groups.groupBy("doc_id", "text_hash").count(), "rows")
    kept = best.select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("text_hash")).join(rows.where("count > 1").withColumnRenamed("doc_id", "d2").withColumnRenamed("text_hash", "t2"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_hash") == F.col("t2")), "left")
    kept = materialize(kept.select(place("doc_id", "text_hash").alias(key), F.col("count").isNotNull().alias("again")), "kept")
    held = docs.withColumn(hash_, F.xxhash64(F.col(text))).withColumn(key, place(doc_id, hash_)).drop(hash_)
    once = held.join(kept.where("not again").select(key), key, "left_semi")
    more = held.join(kept.where("again").select(key), key, "left_semi").dropDuplicates([key])
    return once.select(*docs.columns).unionByName(more.select(*docs.columns))
