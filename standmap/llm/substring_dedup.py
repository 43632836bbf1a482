"""Substring dedup: paragraph MinHash banding with exact Jaccard, and content-anchored passages.

Paragraphs are lines of ``least`` words or more, MIN_WORDS unless the caller says otherwise. Paragraphs that agree in a
band of their MinHash signatures meet, and link if the Jaccard similarity of their five-word shingles is 0.8 or more;
linked ones make up components. Eight bands of three rows find a pair of similarity 0.8 with probability 0.997.
Paragraphs of fewer than SHINGLE words have no signature and meet by the 128-bit hash of their words alone.

A passage inside a longer paragraph shares none of its signature, so runs of MIN_WORDS words that begin at anchors
count as units too, compared by a 128-bit hash of their words. Anchors are the least of each ANCHORS consecutive
three-word hashes, so that any run of ANCHORS + MIN_WORDS + 2 = 50 words that two texts share has a unit in common.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmap.llm.common import free_name, materialize
from standmap.llm.components import components

MIN_WORDS, ANCHORS, SHINGLE, SIMILARITY = 24, 24, 5, 0.8
BANDS, ROWS = 8, 3
#: Paragraphs of one band that a task compares, and words in them; larger buckets are cut into blocks, and each pair of blocks
#: compared. A paragraph of more words is a block of its own.
BLOCK, BLOCK_WORDS = 1024, 250_000
#: Words whose hashes a task remembers.
REMEMBERED = 300_000

_RNG = np.random.default_rng(1234)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """``x`` mixed in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words from their hashes."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out = _mix(out * _P + h[i : i + len(out)])
    return out


def anchors(h: np.ndarray) -> np.ndarray:
    """Where units begin: the leftmost least hash of three words among each ANCHORS of them."""
    g = _runs(h, 3)
    if len(g) <= ANCHORS:
        return np.array([int(g.argmin())] if len(g) else [], np.int64)
    least = np.lib.stride_tricks.sliding_window_view(g, ANCHORS).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def paragraphs(text: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text, A-Z lower-cased, and the word ranges of its lines."""
    words: list[bytes] = []
    ranges = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        w = line.split()
        ranges.append((len(words), len(words) + len(w)))
        words += w
    return words, ranges


def _content(words: list[bytes], lo: int, hi: int) -> bytes:
    """128 bits that stand for words [lo, hi)."""
    return xxhash.xxh3_128_digest(b" ".join(words[lo:hi]))


def _halves(digests: list[bytes]) -> np.ndarray:
    """Digests as two columns of integers."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _band_keys(h: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """The band keys of each paragraph, (n, BANDS)."""
    if not ranges:
        return np.empty((0, BANDS), np.int64)
    s = _runs(h, SHINGLE)
    at = np.concatenate([np.arange(lo, hi - SHINGLE + 1) for lo, hi in ranges])
    sizes = np.array([hi - lo - SHINGLE + 1 for lo, hi in ranges])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    least = np.minimum.reduceat(_mix(s[at][:, None] * _MULTIPLY + _ADD), starts, axis=0)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(ranges), BANDS))
    for r in range(ROWS):
        key = _mix(key * _P + least[:, r::ROWS][:, :BANDS])
    return key.view(np.int64)


def _units(batches, least: int) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for b in batches:
        row, kind, lo, hi, digests, bands = [], [], [], [], [], []
        for i, t in enumerate(b.column(2).to_pylist()):
            words, ranges = paragraphs(t or "")
            ranges = [r for r in ranges if r[1] - r[0] >= least]
            if len(words) < min(least, MIN_WORDS):
                continue
            if len(known) > REMEMBERED:
                known.clear()
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            starts = anchors(h)
            every = [*ranges, *((a, a + MIN_WORDS) for a in starts[starts + MIN_WORDS <= len(words)].tolist())]
            row += [i] * len(every)
            kind += [0] * len(ranges) + [1] * (len(every) - len(ranges))
            lo += [a for a, _ in every]
            hi += [z for _, z in every]
            digests += [_content(words, a, z) for a, z in every]
            bands.append(_band_keys(h, [r for r in ranges if r[1] - r[0] >= SHINGLE]))
        at, (h1, h2) = pa.array(row, pa.int32()), _halves(digests).T.copy()
        runs = np.array(kind, np.int32)
        signed = (runs == 0) & (np.array(hi, np.int32) - np.array(lo, np.int32) >= SHINGLE)
        ends = np.concatenate(([0], np.cumsum(signed) * BANDS)).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *(k.ravel() for k in bands)])), mask=pa.array(~signed))
        columns = [b.column(0).take(at), b.column(1).take(at), pa.array(runs), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(h1), pa.array(h2), keys]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "kind", "lo", "hi", "h1", "h2", "bands"])


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """One row for each paragraph (kind 0) and anchored run (kind 1): its document, words [lo, hi), hashes and band keys."""
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    return held.mapInArrow(lambda batches: _units(batches, max(1, least)), "doc_id long, t long, kind int, lo int, hi int, h1 long, h2 long, bands array<long>")


def _shared_bands(batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and paragraph, those whose key another paragraph has too, each once."""
    last: tuple | None = None
    told = False
    for b in batches:
        out: list[tuple[int, int, int]] = []
        for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if last is not None and row[0] == last[0]:
                if row[1] == last[1]:
                    continue
                if not told:
                    out.append(last)
                out.append(row)
                told = True
            else:
                told = False
            last = row
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["key", "h1", "n"])


def candidates(found: DataFrame) -> DataFrame:
    """(key, h1, n): paragraphs that share a band key with another one, and their words."""
    lines = found.where("kind = 0 and bands is not null").groupBy("h1").agg(F.first("bands").alias("bands"), F.first(F.col("hi") - F.col("lo")).alias("n"))
    rows = lines.select(F.explode("bands").alias("key"), "h1", "n")
    return rows.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(_shared_bands, "key long, h1 long, n int")


def _line_texts(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Paragraphs by hash; those that a task has met lately are not given again, so that a common one doesn't fill a bucket."""
    met: set[bytes] = set()
    for b in batches:
        digests, text = [], []
        if len(met) > REMEMBERED:
            met.clear()
        for t in b.column(0).to_pylist():
            words, ranges = paragraphs(t or "")
            for lo, hi in ranges:
                if hi - lo >= max(least, SHINGLE):
                    line = b" ".join(words[lo:hi])
                    digest = xxhash.xxh3_128_digest(line)
                    if digest not in met:
                        met.add(digest)
                        digests.append(digest)
                        text.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(_halves(digests)[:, 0].copy()), pa.array(text, pa.binary())], ["h1", "line"])


def shingles(line: bytes) -> frozenset:
    w = line.split()
    return frozenset(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


def similar(a: frozenset, b: frozenset) -> bool:
    """Exact Jaccard similarity against the threshold, sizes first."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _forest(batches) -> Iterator[pa.RecordBatch]:
    """Links that join what is linked in each bucket (rows sorted by key, i, j); pairs of joined paragraphs are not compared again."""

    def joined(bucket: dict[int, bytes]) -> Iterator[tuple[int, int]]:
        waiting = {h: shingles(x) for h, x in bucket.items()}
        while waiting:
            front = [waiting.popitem()]
            while front and waiting:
                h, s = front.pop()
                hit = [k for k, x in waiting.items() if similar(s, x)]
                for k in hit:
                    front.append((k, waiting.pop(k)))
                    yield h, k

    last, bucket = None, {}
    for b in itertools.chain(batches, [None]):
        out: list[tuple[int, int]] = []
        for k in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True) if b is not None else [(None,) * 5]:
            if k[:3] != last:
                out += joined(bucket)
                last, bucket = k[:3], {}
            if k[3] is not None:
                bucket[k[3]] = k[4]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def links(docs: DataFrame, found: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(a, b): links between similar paragraphs, by hash, that join every component."""
    keyed = materialize(candidates(found), "candidates")
    wanted = keyed.select("h1").distinct()
    lines = docs.select(F.col(text).alias("text")).mapInArrow(lambda batches: _line_texts(batches, least), "h1 long, line binary").join(wanted, "h1", "left_semi").groupBy("h1").agg(F.first("line").alias("line"))
    sizes = keyed.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("long").alias("blocks"))
    # a bucket beyond a block is dealt to blocks by hash; a block meets every block in a task of its own
    rows = keyed.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("h1"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "h1").join(lines, "h1")
    rows = rows.select("key", "i", "j", "h1", "line").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_forest, "a long, b long").distinct()


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Every occurrence of a paragraph or anchored run that occurs more than once, alike or (paragraphs) nearly alike.

    Columns: doc_id, t (Spark's xxhash64 of the text), kind, lo and hi (words), component (hex), first_doc_id, removed,
    cut_from. The first occurrence of a component, by document id (null last), text hash and place, stays; others are
    removed, words [cut_from, hi) of them, which spares what overlaps the first one in the same document. Paragraphs
    of fewer than ``least`` words are no units of their own, so that shorter texts, null ones too, have none. Rows with equal id and text count as one document. An
    empty table gives an empty result.
    """
    found = materialize(units(docs, doc_id, text, least), "units")
    near = components(links(docs, found, text, least)).withColumnRenamed("node", "h1")
    again = found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")
    wanted = again.join(near, "h1", "full")
    g = F.when(F.col("component").isNull(), F.concat(F.hex("h1"), F.hex("h2"))).otherwise(F.hex("component"))
    # repeated rows of the input are dropped where few units are left
    occurrences = found.drop("bands").join(wanted, "h1").select("doc_id", "t", "kind", "lo", "hi", g.alias("component")).distinct()
    occurrences = materialize(occurrences, "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t", "lo", "hi")
    first = occurrences.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    first = materialize(first)  # so that both sides of the join are shuffled, and a hot component can be split
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    out = occurrences.join(first, "component")
    return out.select(
        "doc_id", "t", "kind", "lo", "hi", "component", F.col("first.doc_id").alias("first_doc_id"), (place > F.col("first")).alias("removed"),
        F.when(same, F.least(F.col("hi"), F.greatest("lo", "first.hi"))).otherwise(F.col("lo")).alias("cut_from"),
    )


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the removed passages: words of them go, with the white space before each."""
    passages = repeated_passages(docs, doc_id, text, least).where("removed and cut_from < hi")
    key = lambda d, t: F.concat_ws("|", d.isNull().cast("string"), d.cast("string"), t.cast("string"))
    at, spans = free_name(docs, "place"), free_name(docs, "spans")
    # a list has no more entries than its document has units
    gone = passages.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("cut_from", "hi"))).alias(spans))
    gone = gone.select(key(F.col("doc_id"), F.col("t")).alias(at), spans)
    names = docs.columns

    def cut(batches):
        for b in batches:
            i, texts = b.schema.get_field_index(text), b.column(b.schema.get_field_index(text)).to_pylist()
            left = [t if not s or t is None else without(t, [(x["cut_from"], x["hi"]) for x in s]) for t, s in zip(texts, b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if j == i else b.column(j) for j in range(len(names))], names)

    held = docs.withColumn(at, key(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))).join(gone, at, "left")
    return held.select(*names, spans).mapInArrow(cut, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` and the white space before each of them."""
    raw, out, last, at = text.encode("utf-8", "surrogatepass"), [], 0, 0
    gone = set(itertools.chain.from_iterable(range(lo, hi) for lo, hi in spans))
    space = np.isin(np.frombuffer(raw, np.uint8), (0x20, 9, 10, 11, 12, 13))
    inside = np.concatenate(([False], ~space, [False]))
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    for at, (_, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if at not in gone:
            out.append(raw[last:hi])
        last = hi
    return (b"".join(out) + raw[last:]).decode("utf-8", "surrogatepass")
