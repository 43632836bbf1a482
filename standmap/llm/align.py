"""Cross-tokenizer alignment: tokens of a byte-level BPE and of a piece model, grouped at the byte offsets where both end.

The ends that two token sequences share are found by galloping: the text's shorter list of ends drives, and each of its
ends is looked for in the longer one from where the last was found, by steps that double and then by halving. Chunks of
the driving lists are lanes that numpy moves on together. The ranks of shared ends cut both sequences into groups, and
rank differences say how many tokens of either side overlap.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standmap.llm.common import free_name, materialize

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Ends of a driving list that a lane goes through, and bytes of text that are aligned together, one text at least.
LANE, TOGETHER = 128, 4 << 20
#: A group of more token pairs than this is put together from its distinct ids.
LARGE = 4096
#: Most frequent id pairs whose counts are broadcast; all others meet their documents in a join.
HOT = 262_144


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE: ids of texts, and each id's bytes. Special tokens' strings are plain text."""

    #: How a byte-level BPE of this kind splits a text: endings, letters, digits, others, white space.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        special = {t["content"] for t in spec["added_tokens"]}
        byte = _byte_of()
        vocab = spec["model"]["vocab"]
        self.raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.raw[i] = token.encode() if token in special else bytes(map(byte.__getitem__, token))
        # a merge's rank is its token's, so that the same merges take place in the same order
        self.quick = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks={self.raw[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})
        self.slow = tokenizers.Tokenizer.from_buffer(file)
        self.slow.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        try:
            return self.quick.encode_ordinary(text)
        except Exception:  # its pattern gives up on some very long runs
            return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A sentencepiece model: ids of texts, and each id's bytes with U+2581 as a space."""

    def __init__(self, file: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = self.model.get_piece_size()
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def gallop(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in ``ends`` where a driving list's end stands in the longer list too, by i.

    Lane k drives over places lo[k] .. hi[k] - 1 and searches at[k] .. stop[k] - 1; both ascend.
    """
    i, p, last = lo.copy(), at.copy(), len(ends) - 1
    live, found = np.flatnonzero(lo < hi), []
    while live.size:
        value, left, top = ends[i[live]], p[live], stop[live]
        right = left.copy()
        open_ = np.flatnonzero((left < top) & (ends[np.minimum(left, last)] < value))
        left[open_] += 1
        right[open_] = top[open_]
        width = 1
        while open_.size:  # steps that double, until one isn't below the value
            probe = left[open_] + width - 1
            inside = probe < top[open_]
            below = inside & (ends[np.minimum(probe, last)] < value[open_])
            right[open_[inside & ~below]] = probe[inside & ~below]
            left[open_[below]] = probe[below] + 1
            open_ = open_[below]
            width *= 2
        open_ = np.flatnonzero(left < right)
        while open_.size:  # halving
            mid = (left[open_] + right[open_]) >> 1
            below = ends[mid] < value[open_]
            left[open_[below]] = mid[below] + 1
            right[open_[~below]] = mid[~below]
            open_ = open_[left[open_] < right[open_]]
        hit = (left < top) & (ends[np.minimum(left, last)] == value)
        found.append((i[live[hit]], left[hit]))
        p[live] = left
        i[live] += 1
        live = live[i[live] < hi[live]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def shared_ends(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the ends that a text's two lists share; the lists of all texts follow one another, n_a and n_b long.

    Ends are counted on from text to text, so that both lists ascend.
    """
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b + len(a)
    drives = n_a <= n_b
    short, lo = np.where(drives, n_a, n_b), np.where(drives, first_a, first_b)
    at, stop = np.where(drives, first_b, first_a), np.where(drives, first_b + n_b, first_a + n_a)
    lanes = -(-short // LANE)
    of = np.repeat(np.arange(len(short)), lanes)
    begin = lo[of] + (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    i, j = gallop(np.concatenate((a, b)), begin, np.minimum(begin + LANE, (lo + short)[of]), at[of], stop[of])
    swap = i >= len(a)
    i, j = np.where(swap, j, i), np.where(swap, i, j) - len(a)
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


class Aligned:
    """Tokens of some texts and their groups: ``a`` and ``b`` ids of all texts in a row, group g ends before stop_a[g] and stop_b[g]."""

    def __init__(self, one: ByteTokens, two: PieceTokens, lengths: tuple[np.ndarray, np.ndarray], texts: list[str | None]):
        ids_a, ids_b = [], []
        for t in texts:
            raw = f" {t}".encode() if t else b""
            x, y = (one.encode(f" {t}"), two.encode(t)) if t else ([], [])
            if b"".join(map(one.raw.__getitem__, x)) != raw or b"".join(map(two.raw.__getitem__, y)) != raw:
                x, y = [], []
            ids_a.append(x)
            ids_b.append(y)
        self.n_a, self.n_b = (np.array(list(map(len, ids)), np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        i, j = shared_ends(np.cumsum(lengths[0][self.a]), np.cumsum(lengths[1][self.b]), self.n_a, self.n_b)
        self.stop_a, self.stop_b = i + 1, j + 1
        self.size_a, self.size_b = np.diff(self.stop_a, prepend=0), np.diff(self.stop_b, prepend=0)
        #: groups of each text, which end with it
        self.groups = np.diff(np.searchsorted(self.stop_a, np.cumsum(self.n_a), "right"), prepend=0)

    def links(self) -> np.ndarray:
        """Token pairs that share a group, by text."""
        total = np.concatenate(([0], np.cumsum(self.size_a * self.size_b)))
        at = np.cumsum(self.groups)
        return total[at] - total[at - self.groups]

    def written(self, tables: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """The groups of each text: ids of both sides, ``tables`` giving an id with what follows it inside a group and at its end."""
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, stop, size, table, before in ((self.a, self.stop_a, self.size_a, tables[0], self.stop_b - self.size_b), (self.b, self.stop_b, self.size_b, tables[1], self.stop_a)):
            last = np.zeros(len(ids), np.int64)
            last[stop - 1] = 1
            out[np.arange(len(ids)) + np.repeat(before, size)] = table[ids * 2 + last]
        at = np.cumsum(self.n_a + self.n_b)
        return [b"".join(out[lo:hi].tolist())[:-1] for lo, hi in zip((at - self.n_a - self.n_b).tolist(), at.tolist(), strict=True)]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a * width + b, links) of the distinct id pairs of each text, in order."""
        text = np.repeat(np.arange(len(self.groups)), self.groups)
        large = self.size_a * self.size_b > LARGE
        n = np.where(large, 0, self.size_a * self.size_b)
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        first_a, first_b = (self.stop_a - self.size_a)[of], (self.stop_b - self.size_b)[of]
        across = self.size_b[of]
        key = (text[of] << 40) + self.a[first_a + k // across] * width + self.b[first_b + k % across]
        keys, counts = np.unique(key, return_counts=True)
        more = [(keys, counts)]
        for g in np.flatnonzero(large).tolist():
            (x, m), (y, w) = (np.unique(ids[stop - size : stop], return_counts=True) for ids, stop, size in ((self.a, self.stop_a[g], self.size_a[g]), (self.b, self.stop_b[g], self.size_b[g])))
            more.append((((text[g] << 40) + x[:, None] * width + y).ravel(), (m[:, None] * w).ravel()))
        if len(more) > 1:
            keys, place = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, np.concatenate([c for _, c in more]))
        return keys >> 40, keys & ((1 << 40) - 1), counts


class Aligner:
    """Both tokenizers, kept in a worker from task to task."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.one, self.two = ByteTokens(a_file), PieceTokens(b_file)
        self.lengths = tuple(np.array(list(map(len, t.raw)), np.int64) for t in (self.one, self.two))
        self.width = len(self.two.raw)
        self.tables = tuple(np.array([f"{i}{c}".encode() for i in range(len(t.raw)) for c in (",", end)], object) for t, end in ((self.one, "|"), (self.two, ";")))

    def align(self, texts: list[str | None]) -> Aligned:
        return Aligned(self.one, self.two, self.lengths, texts)


_HELD: dict[tuple[bytes, bytes], Aligner] = {}


def _aligner(a_file: bytes, b_file: bytes) -> Aligner:
    k = (hashlib.sha1(a_file).digest(), hashlib.sha1(b_file).digest())
    if k not in _HELD:
        _HELD.clear()
        _HELD[k] = Aligner(a_file, b_file)
    return _HELD[k]


def _portions(texts: pa.Array):
    """Lists of texts of about ``TOGETHER`` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values, kind))


def _mapped(docs: DataFrame, text: str, a_file: str, b_file: str, more: list[T.StructField], made) -> DataFrame:
    """``docs`` with the columns ``more``, which ``made`` (aligner, aligned texts) gives as arrays."""
    docs = docs.drop(*(f.name for f in more))
    files = []
    for name in (a_file, b_file):
        with open(name, "rb") as f:
            files.append(f.read())
    held = docs.sparkSession.sparkContext.broadcast(tuple(files))  # two vocabularies, about three megabytes
    names = [*docs.columns, *(f.name for f in more)]

    def run(batches):
        aligner = _aligner(*held.value)
        for b in batches:
            for lo, hi, texts in _portions(b.column(b.schema.get_field_index(text))):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *made(aligner, aligner.align(texts))], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def align_tokens(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text: str = "text") -> DataFrame:
    """``docs`` with a_ids and b_ids, and a_stops and b_stops: how many tokens of either side come before each shared end.

    A reads a space and the text; B puts that space itself. Group g is a_ids[a_stops[g-1]:a_stops[g]] against
    b_ids[b_stops[g-1]:b_stops[g]]. Null and empty texts, and those whose tokens' bytes aren't the space and the text on
    both sides (a text that holds U+2581), have no tokens. Columns so called are replaced; repeated rows come out alike.
    """

    def made(_, x: Aligned):
        before_a, before_b = (np.repeat(np.cumsum(n) - n, x.groups) for n in (x.n_a, x.n_b))
        return [_lists(v.astype(np.int32), n, pa.int32()) for v, n in ((x.a, x.n_a), (x.b, x.n_b), (x.stop_a - before_a, x.groups), (x.stop_b - before_b, x.groups))]

    return _mapped(docs, text, a_file, b_file, [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_ids", "b_ids", "a_stops", "b_stops")], made)


_PAIRS = [
    *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.IntegerType())),
]


def linked_pairs(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text: str = "text") -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups_sha256, and ``pairs`` (A id times B's vocabulary, plus B id) with their ``links``.

    A link is a pair of an A and a B token in one group. ``groups_sha256`` is the hash of the groups' ids as text
    (``a1,a2|b1;a3|b2``), '' without tokens. Rules for texts and columns are those of :func:`align_tokens`.
    """

    def made(aligner: Aligner, x: Aligned):
        of, pairs, links = x.pairs(aligner.width)
        n = np.bincount(of, minlength=len(x.n_a))
        digest = [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(aligner.tables)]
        return [*map(pa.array, (x.n_a, x.n_b, x.groups.astype(np.int64), x.links())), pa.array(digest, pa.string()), _lists(pairs, n, pa.int64()), _lists(links.astype(np.int32), n, pa.int32())]

    return _mapped(docs, text, a_file, b_file, _PAIRS, made)


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many rows of :func:`linked_pairs` each id pair is linked, and whether that is its A id's highest count."""
    n = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    n = materialize(n.withColumn("a", F.floor(F.col("pair") / width).cast("int")), "pair_counts")
    top = n.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary at most
    return n.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_support(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text: str = "text") -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum (longs).

    A pair's count is the number of rows that hold it linked, repeated rows each. ``count_sum`` adds it up over a row's
    links, ``n_best`` counts the links whose count is the highest of their A id, ties included. The counts of the
    ``HOT`` most frequent pairs are broadcast; a row's other pairs meet theirs in a join. Rules for texts and columns
    are those of :func:`align_tokens`; an empty table gives an empty result.
    """
    row = free_name(docs, "row")
    kept = materialize(linked_pairs(docs.withColumn(row, F.monotonically_increasing_id()), a_file, b_file, text), "linked")
    counts = materialize(pair_counts(kept, sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()), "counts")
    hot = sorted(counts.orderBy(F.desc("n"), "pair").limit(HOT).collect())  # HOT rows at most
    tables = tuple(np.array([r[c] for r in hot], kind) for c, kind in enumerate((np.int64, np.int64, np.int64)))
    held = kept.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        pair, n, best = held.value
        for b in batches:
            rows, pairs, links = b.columns
            lengths = np.diff(pairs.offsets.to_numpy())
            p, k = pairs.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
            known = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            total, most = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            np.add.at(total, of[known], k[known] * n[at[known]])
            np.add.at(most, of[known], k[known] * best[at[known]])
            rest = np.bincount(of[~known], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays([rows, pa.array(total), pa.array(most), _lists(p[~known], rest, pa.int64()), _lists(k[~known].astype(np.int32), rest, pa.int32())], ["row", "count_sum", "n_best", "pairs", "links"])

    first = kept.select(F.col(row).alias("row"), "pairs", "links").mapInArrow(run, "row long, count_sum long, n_best long, pairs array<long>, links array<int>")
    first = materialize(first, "hot_links")
    rest = first.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("k"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("s"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("m"))
    sums = first.join(rest, "row", "left").select(F.col("row").alias(row), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"), (F.col("n_best") + F.coalesce("m", F.lit(0))).alias("n_best"))
    return kept.drop("pairs", "links", "count_sum", "n_best").join(sums, row).drop(row)
