"""BPE pieces with seeded merge dropout, and their lossless decoding.

Symbols merge best score first, leftmost first among equals, from an agenda. A candidate that comes up is skipped if
its own hash falls below the dropout rate. The hash is keyed by the seed, the document, the place of the run of text in
the document, and where the candidate begins, meets and ends, so each occurrence of a word draws its own segmentation,
and a document always gets the same pieces.

What doesn't depend on the draw is remembered for each run: its pieces without dropout and the merges that lead there.
An occurrence that skips none of these merges has these pieces; every other occurrence runs its own agenda.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the model is by default; every function takes another path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Runs of text that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 500_000, 64
#: Longest run whose agenda advances in step with others, and characters of text that are looked at together.
IN_STEP, TOGETHER = 32, 1_500_000

_MASK = (1 << 64) - 1
_NEVER = 1 << 40
_RUN = re.compile(r" +[^ \n]*|\n|[^ \n]+")
#: Odd multipliers for a candidate's three bounds, for a run's place, and for mixing.
_LO, _MID, _HI, _AT, _M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits mixed into 53 that look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11)


def mixed_one(x: int) -> int:
    """:func:`mixed` of one integer."""
    x &= _MASK
    x = (x ^ (x >> 30)) * _M1 & _MASK
    x = (x ^ (x >> 27)) * _M2 & _MASK
    return (x ^ (x >> 31)) >> 11


def bounds(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A candidate's bounds as one number, to which a run's key is added."""
    return lo.astype(np.uint64) * np.uint64(_LO) + mid.astype(np.uint64) * np.uint64(_MID) + hi.astype(np.uint64) * np.uint64(_HI)


class Pieces:
    """The vocabulary with spaces as spaces: ``rank`` (best score first) and ``id`` of pieces, ``raw`` bytes by id."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.id: dict[str, int] = {}
        score: dict[str, float] = {}
        self.byte, self.raw = [0] * 256, []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.id[piece], score[piece] = i, sp.get_score(i)
                self.raw.append(piece.encode())
        order = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {piece: order[x] for piece, x in score.items()}
        self._pairs()
        # no piece crosses into a new run, so runs are encoded by themselves
        self.runs = all("\n" not in p and " " not in p.lstrip(" ") for p in self.id)

    def _pairs(self) -> None:
        """What merges with what, as sorted arrays: symbols are the pieces and the characters that they hold."""
        symbols = list(dict.fromkeys([*self.id, *(c for p in self.id for c in p)]))
        number = {x: i for i, x in enumerate(symbols)}
        self.n_symbols = len(symbols)
        self.symbol_id = np.array([self.id.get(x, -1) for x in symbols], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for x, i in number.items():
            if len(x) == 1:
                self.symbol_of[ord(x)] = i
        found = [(number[p[:i]] * len(symbols) + number[p[i:]], self.rank[p], number[p]) for p in self.id for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        found.sort()
        pairs, ranks, merged = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.pairs, self.pair_rank, self.pair_merged = pairs, np.append(ranks, _NEVER), np.append(merged, -1)

    def encode_in_step(self, runs: list[str], key: np.ndarray, limit: int, merges: list | None = None) -> list[bytes]:
        """:func:`encode_run` of runs of one length, as int32 bytes: all agendas take their best candidate at a time.

        ``merges`` gets the runs' numbers and the bounds of their merges, step by step.
        """
        n, out = len(runs[0]), [b""] * len(runs)
        codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        sym = self.symbol_of[codes]
        row, ends = np.arange(len(runs)), np.broadcast_to(np.arange(n + 1, dtype=np.int64), (len(runs), n + 1))

        def candidates(a, b, key, lo, mid, hi):
            """Index of each pair's merge; the last index stands for none, or for one that is skipped."""
            k = a * self.n_symbols + b
            at = np.searchsorted(self.pairs, k)
            none = (a < 0) | (b < 0) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != k)
            if limit:
                none |= mixed(key + bounds(lo, mid, hi)) < np.uint64(limit)
            return np.where(none, len(self.pairs), at)

        cand = candidates(sym[:, :-1], sym[:, 1:], key[:, None], ends[:, :-2], ends[:, 1:-1], ends[:, 2:])
        while True:
            m = sym.shape[1]
            rank = self.pair_rank[cand]
            best = rank.argmin(axis=1) if m > 1 else np.zeros(len(row), np.int64)
            go = rank[np.arange(len(row)), best] < _NEVER if m > 1 else np.zeros(len(row), bool)
            if not go.all():
                stop = ~go
                ids, where = self.symbol_id[sym[stop]], ends[stop]
                ids[sym[stop] < 0] = -1
                whole, raw = (ids >= 0).all(axis=1), ids.tobytes()
                for i, r in enumerate(row[stop].tolist()):
                    out[r] = raw[4 * m * i : 4 * m * (i + 1)] if whole[i] else self._bytes(runs[r], ids[i].tolist(), where[i].tolist())
                row, sym, ends, cand, key, best = (x[go] for x in (row, sym, ends, cand, key, best))
            if not len(row):
                return out
            i = np.arange(len(row))
            new = self.pair_merged[cand[i, best]]
            if merges is not None:
                merges.append((row, bounds(ends[i, best], ends[i, best + 1], ends[i, best + 2])))
            cols = np.arange(m - 1)
            sym = np.take_along_axis(sym, cols + (cols > best[:, None]), 1)
            sym[i, best] = new
            cols = np.arange(m)
            ends = np.take_along_axis(ends, cols + (cols > best[:, None]), 1)
            cols = np.arange(m - 2)
            cand = np.take_along_axis(cand, cols + (cols >= best[:, None]), 1)
            for at, of in ((best - 1, best > 0), (best, best < m - 2)):
                r, a = i[of], at[of]
                if len(r):
                    cand[r, a] = candidates(sym[r, a], sym[r, a + 1], key[r], ends[r, a], ends[r, a + 1], ends[r, a + 2])

    def _bytes(self, run: str, ids: list[int], ends: list[int]) -> bytes:
        """Ids of a run of which some symbols (-1) are no pieces."""
        out = array("i")
        for x, lo, hi in zip(ids, ends, ends[1:], strict=False):
            out.extend([x] if x >= 0 else [self.byte[b] for b in run[lo:hi].encode("utf-8", "surrogatepass")])
        return out.tobytes()

    def encode_run(self, run: str, key: int, limit: int, merges: list[int] | None = None) -> list[int]:
        """Pieces of one run. A candidate is skipped if the hash of ``key`` and its bounds is below ``limit``.

        A candidate is one integer: its rank, then where it begins, meets and ends. ``merges`` gets the bounds of merges.
        """
        rank, n = self.rank.get, len(run)
        end = list(range(1, n + 1))  # of the symbol that begins here; 0: none does
        before = list(range(-1, n - 1))
        b = n.bit_length()
        b2, b3, mask = 2 * b, 3 * b, (1 << b) - 1
        agenda = [(r << b3) | (i << b2) | (i + 1 << b) | i + 2 for i in range(n - 1) if (r := rank(run[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            c = heappop(agenda)
            lo, mid, hi = c >> b2 & mask, c >> b & mask, c & mask
            if end[lo] != mid or end[mid] != hi:
                continue
            at = lo * _LO + mid * _MID + hi * _HI
            if limit and mixed_one(key + at) < limit:
                continue
            if merges is not None:
                merges.append(at & _MASK)
            end[lo], end[mid] = hi, 0
            if hi < n:
                before[hi] = lo
                to = end[hi]
                if (r := rank(run[lo:to])) is not None:
                    heappush(agenda, (r << b3) | (lo << b2) | (hi << b) | to)
            if (prev := before[lo]) >= 0 and (r := rank(run[prev:hi])) is not None:
                heappush(agenda, (r << b3) | (prev << b2) | (lo << b) | hi)
        out, i = [], 0
        while i < n:
            piece = run[i : end[i]]
            if piece in self.id:
                out.append(self.id[piece])
            else:
                out += [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            i = end[i]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that encoding puts before it."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class _Runs(dict):
    """Runs of text, numbered as they appear, with their ``names`` by number."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, run: str) -> int:
        i = self[run] = len(self.names)
        self.names.append(run)
        return i


class Encoder:
    """Encodes texts as int32 bytes, remembering what the runs that it has met lately come to without dropout."""

    def __init__(self, pieces: Pieces, rate: float, seed: int):
        self.pieces, self.seed, self.limit = pieces, seed, int(rate * (1 << 53))
        self._forget()

    def _forget(self) -> None:
        self.runs, self.plain = _Runs(), []
        self.length = self.first = self.merges = np.zeros(0, np.int64)
        self.bounds = np.zeros(0, np.uint64)

    def document_key(self, doc_id: object) -> int:
        return xxhash.xxh64_intdigest(str(doc_id).encode("utf-8", "surrogatepass"), self.seed & _MASK)

    def encode(self, text: str, doc_id: object) -> bytes:
        return self.encode_all([text], [doc_id])[0]

    def encode_all(self, texts: list[str], doc_ids: list) -> list[bytes]:
        split = [(_RUN.findall(f" {t}") if self.pieces.runs else [f" {t}"]) if t else [] for t in texts]
        if len(self.plain) >= REMEMBERED:
            self._forget()
        counts = np.array([len(x) for x in split], np.int64)
        run = np.fromiter((self.runs[r] for x in split for r in x), np.int64, counts.sum())
        self._learn()
        # a run's key: its document's, and where in the document it begins
        length = self.length[run]
        before = np.cumsum(length) - length
        firsts = np.concatenate(([0], np.cumsum(counts)))
        text = np.repeat(np.arange(len(texts)), counts)
        place = (before - before[firsts[text]] if len(run) else before).astype(np.uint64)
        key = np.array([self.document_key(k) for k in doc_ids], np.uint64)[text] + place * np.uint64(_AT)
        out = [self.plain[i] for i in run.tolist()]
        drawn = self._drawn(run, key)
        for i, ids in zip(drawn.tolist(), self._encoded([self.runs.names[k] for k in run[drawn].tolist()], key[drawn], self.limit), strict=True):
            out[i] = ids
        for i in np.unique(run[length > LONGEST]).tolist():  # of these nothing is kept but a number
            self.runs.pop(self.runs.names[i])
            self.runs.names[i] = ""
        return [b"".join(out[lo:hi]) for lo, hi in zip(firsts.tolist(), firsts[1:].tolist(), strict=False)]

    def _drawn(self, run: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Places of the runs that skip some merge of their plain segmentation, or aren't remembered with one."""
        if not self.limit:
            return np.flatnonzero(self.length[run] > LONGEST)
        n = self.merges[run]
        of = np.repeat(np.arange(len(run)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[run][of]
        skips = mixed(key[of] + self.bounds[at]) < np.uint64(self.limit)
        return np.flatnonzero((np.bincount(of[skips], minlength=len(run)) > 0) | (self.length[run] > LONGEST))

    def _encoded(self, runs: list[str], key: np.ndarray, limit: int, merges: list | None = None) -> list[bytes]:
        """Ids of each run under its key; ``merges`` gets (numbers of runs, bounds) of all merges."""
        out, length = [b""] * len(runs), np.array([len(r) for r in runs], np.int64)
        order = np.argsort(length, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            group = [runs[i] for i in same.tolist()]
            if 1 < len(group[0]) <= IN_STEP and len(group) > 8:
                steps: list | None = None if merges is None else []
                for i, ids in zip(same.tolist(), self.pieces.encode_in_step(group, key[same], limit, steps), strict=True):
                    out[i] = ids
                if merges is not None:
                    merges += [(same[row], b) for row, b in steps]
                continue
            for i, r in zip(same.tolist(), group, strict=True):
                own: list | None = None if merges is None else []
                out[i] = array("i", self.pieces.encode_run(r, int(key[i]), limit, own)).tobytes()
                if own:
                    merges.append((np.full(len(own), i), np.array(own, np.uint64)))
        return out

    def _learn(self) -> None:
        """Plain pieces and merges of the runs that were numbered since the last call; none for those that are too long."""
        new = self.runs.names[len(self.plain) :]
        short = [i for i, r in enumerate(new) if len(r) <= LONGEST]
        merges: list = []
        ids = self._encoded([new[i] for i in short], np.zeros(len(short), np.uint64), 0, merges)
        plain = [b""] * len(new)
        for i, x in zip(short, ids, strict=True):
            plain[i] = x
        at = np.array(short, np.int64)[np.concatenate([np.zeros(0, np.int64), *(x for x, _ in merges)])]
        found = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in merges)])[np.argsort(at, kind="stable")]
        n = np.bincount(at, minlength=len(new))
        self.plain += plain
        self.length = np.append(self.length, np.array([len(r) for r in new], np.int64))
        self.first = np.append(self.first, len(self.bounds) + np.cumsum(n) - n)
        self.merges = np.append(self.merges, n)
        self.bounds = np.append(self.bounds, found)


def _portions(texts: list) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about TOGETHER characters, one text at least."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= TOGETHER:
            out.append((lo, i + 1))
            lo, size = i + 1, 0
    return [*out, (lo, len(texts))] if lo < len(texts) else out


_HELD: dict[tuple, Encoder] = {}


def _encoder(model: bytes, rate: float, seed: int) -> Encoder:
    """The worker's encoder, kept from task to task."""
    k = (xxhash.xxh64_intdigest(model), rate, seed)
    if k not in _HELD:
        _HELD.clear()
        _HELD[k] = Encoder(Pieces(model), rate, seed)
    return _HELD[k]


def encode_pieces(docs: DataFrame, model: str = MODEL, rate: float = 0.1, seed: int = 11, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int>, ``n_pieces`` long and ``lossless``: whether the ids decode to the text.

    ``rate`` is the share of merges that are skipped (0: the model's own segmentation), drawn anew for each document and
    each place in it; rows with equal id and text get equal pieces, null ids draw alike. A null text has null ids and
    0 pieces, an empty one no ids; both count as lossless. Characters that the vocabulary lacks, the mark for spaces
    among them, become byte pieces. Columns so called are replaced.
    """
    docs = docs.drop("ids", "n_pieces", "lossless")
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, about half a megabyte
    names = docs.columns

    def run(batches):
        encoder = _encoder(held.value, rate, seed)
        for b in batches:
            keys, texts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (doc_id, text))
            found = []
            for lo, hi in _portions(texts):
                ids = encoder.encode_all([t or "" for t in texts[lo:hi]], keys[lo:hi])
                found += [None if t is None else x for t, x in zip(texts[lo:hi], ids, strict=True)]
            lengths = np.array([len(x or b"") // 4 for x in found], np.int64)
            values = np.frombuffer(b"".join(x or b"" for x in found), np.int32)
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(x is None for x in found), False])), pa.array(values))
            same = [t is None or encoder.pieces.decode(values[lo:hi].tolist()) == t for t, lo, hi in zip(texts, ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(lengths), pa.array(same, pa.bool_())], [*names, "ids", "n_pieces", "lossless"])

    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def decode_pieces(rows: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with ``into``: the text of ``ids``, null for null. A column so called is replaced."""
    rows = rows.drop(into)
    with open(model, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())
    names = rows.columns

    def run(batches):
        pieces = Pieces(held.value)
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))
