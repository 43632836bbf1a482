"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

The automaton reads words, not characters: the benchmark's words are numbers, all other words are zero. It is a few
integer arrays over its nodes, made level by level from the sorted windows: a window of ten words takes ten nodes at most,
of seventeen bytes, so that a benchmark of 1.6 million words is one automaton of about 300 MB, its windows' items included. Texts follow one another
with a zero between, and are cut into lanes that numpy moves on together, a word at a time. Each lane begins a window
early, at the root, as no match is longer.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standmap.llm.common import free_name

#: Nodes that one automaton may have, WINDOW for each word of the benchmark; a benchmark beyond is scanned in blocks of whole items.
MAX_NODES = 16_000_000
WINDOW = 10
#: Words of a lane, and bytes of text that are scanned together, one text at least.
LANE, TOGETHER = 64, 4 << 20

# Bytes that separate words become a space and A-Z become a-z; what is left is 0-9, a-z and all of UTF-8's other characters.
_NORMAL = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _below(first: np.ndarray, word: np.ndarray, node: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The followers of nodes by words, 0 where there is none."""
    left, top = first[node], first[node + 1]
    right = top.copy()
    while (open_ := np.flatnonzero(left < right)).size:
        mid = (left[open_] + right[open_]) >> 1
        less = word[mid] < w[open_]
        left[open_[less]] = mid[less] + 1
        right[open_[~less]] = mid[~less]
    found = left < top
    found[found] = word[left[found]] == w[found]
    return np.where(found, left, 0)


@dataclass
class Automaton:
    """Nodes by depth, then by their words; 0 is the root, and stands for none elsewhere.

    ``first``: node k's followers are first[k] .. first[k + 1] - 1, by ``word``, the word that leads to a node; the root's
    are in ``start`` by word. ``fail``: the node of the longest proper ending that is a node; ``hit``: the node itself
    or the next one down its fails that is a window's end; ``depth``: a node's words. ``of`` numbers the windows by
    their ends; window r is in items[owner[owned[r]]] .. items[owner[owned[r + 1] - 1]].
    """

    number: dict[bytes, int]
    items: list[str]
    start: np.ndarray
    first: np.ndarray
    word: np.ndarray
    fail: np.ndarray
    hit: np.ndarray
    depth: np.ndarray
    ends: np.ndarray
    owned: np.ndarray
    owner: np.ndarray

    def step(self, node: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where words lead from nodes, by fails where a node has no such follower; word 0 leads to the root."""
        to, at, open_ = self.start[w], node.copy(), np.flatnonzero((node > 0) & (w > 0))
        while open_.size:
            below = _below(self.first, self.word, at[open_], w[open_])
            to[open_[below > 0]] = below[below > 0]
            open_ = open_[below == 0]
            at[open_] = self.fail[at[open_]]
            open_ = open_[at[open_] > 0]
        return to

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, node) of all windows that end at a place of ``words``, by place."""
        early = int(self.depth.max()) - 1 if len(self.depth) > 1 else 0
        lanes = -(-len(words) // LANE)
        padded = np.zeros(early + lanes * LANE, np.int32)
        padded[early : early + len(words)] = words
        at, node, found = np.arange(lanes) * LANE, np.zeros(lanes, np.int32), []
        for j in range(early + LANE):
            w = padded[at + j]
            live = np.flatnonzero(w)
            after = np.zeros(lanes, np.int32)
            after[live] = self.step(node[live], w[live])
            node = after
            if j >= early:
                lane = live[self.hit[node[live]] > 0]
                end = self.hit[node[lane]]
                while lane.size:  # and the shorter windows that end here
                    found.append((at[lane] + j - early, end))
                    end = self.hit[self.fail[end]]
                    lane, end = lane[end > 0], end[end > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        place, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], end[order]

    def names(self, nodes: np.ndarray) -> set[str]:
        """The items that hold the windows that end at ``nodes``."""
        r = np.searchsorted(self.ends, np.unique(nodes))
        return {self.items[k] for lo, hi in zip(self.owned[r].tolist(), self.owned[r + 1].tolist(), strict=True) for k in self.owner[lo:hi].tolist()}


def automaton(items: list[tuple[str, str]], window: int = WINDOW) -> Automaton:
    """Over the windows of items: ``window`` consecutive words, or all of an item's words if fewer."""
    number: dict[bytes, int] = {}
    names = sorted({i for i, _ in items})
    place = {i: k for k, i in enumerate(names)}
    parts, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
    for i, text in items:
        w = np.array([number.setdefault(x, len(number) + 1) for x in normal_words(text)], np.int32)
        if len(w):
            parts.append(np.lib.stride_tricks.sliding_window_view(w, window) if len(w) >= window else np.pad(w, (0, window - len(w)))[None])
            owners.append(np.full(len(parts[-1]), place[i]))
    rows, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((owner, *rows.T[::-1]))
    rows, owner = rows[order], owner[order]
    # by row, whether it differs from the one before within its first d words
    new = np.ones((len(rows), window), bool)
    new[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    distinct = new[:, -1]
    kept = distinct.copy()
    kept[1:] |= owner[1:] != owner[:-1]
    owned = np.append(np.flatnonzero(distinct[kept]), kept.sum())
    rows, new, owner = rows[distinct], new[distinct], owner[kept]

    word, depth, parent, total, at = [np.zeros(1, np.int32)], [np.zeros(1, np.int8)], [], 1, np.zeros(len(rows), np.int32)
    end, levels = np.zeros(len(rows), np.int32), []
    for d in range(window):
        begins = np.flatnonzero(new[:, d] & (rows[:, d] > 0))
        inside = rows[:, d] > 0
        parent.append(at[begins])
        word.append(rows[begins, d])
        depth.append(np.full(len(begins), d + 1, np.int8 if window < 128 else np.int32))
        levels.append((total, total + len(begins)))
        at = np.where(inside, total - 1 + np.cumsum(new[:, d] & inside), at).astype(np.int32)
        end = np.where(inside, at, end)
        total += len(begins)
    word, depth, parent = np.concatenate(word), np.concatenate(depth), np.concatenate(parent)
    first = np.concatenate(([1], 1 + np.cumsum(np.bincount(parent, minlength=total)))).astype(np.int32)
    start = np.zeros(len(number) + 1, np.int32)
    start[word[1 : first[1]]] = np.arange(1, first[1])
    by_end = np.argsort(end)
    hit = np.zeros(total, np.int32)
    hit[end] = end
    sizes = np.diff(owned)[by_end]
    owner = owner[np.repeat(owned[:-1][by_end] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))]
    owned = np.concatenate(([0], np.cumsum(sizes)))
    out = Automaton(number, names, start, first, word, np.zeros(total, np.int32), hit, depth, end[by_end], owned, owner)
    for lo, hi in levels[1:]:
        out.fail[lo:hi] = out.step(out.fail[parent[lo - 1 : hi - 1]], word[lo:hi])
        out.hit[lo:hi] = np.where(hit[lo:hi] > 0, hit[lo:hi], out.hit[out.fail[lo:hi]])
    return out


def char_offsets(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Character offsets in ``text`` of the word ranges ``spans`` (ends exclusive)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate(([False], np.frombuffer(_NORMAL, np.uint8)[raw] != 0x20, [False]))
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [[int(chars[starts[a]]), int(chars[ends[b - 1]])] for a, b in spans]


def scan_all(texts: list[str], a: Automaton) -> list[tuple[int, int, set[str], list[list[int]]]]:
    """By text: number of words, words hit, items that occur, and the hit spans in characters of the original text."""
    numbers = [np.fromiter(map(a.number.get, w, repeat(0)), np.int32, len(w)) for w in map(normal_words, texts)]
    begins = np.cumsum([0, *(len(x) + 1 for x in numbers)])  # a zero after each text
    words = np.zeros(begins[-1], np.int32)
    for x, lo in zip(numbers, begins.tolist(), strict=False):
        words[lo : lo + len(x)] = x
    place, end = a.matches(words)
    cuts = np.searchsorted(place, begins)
    out = []
    for k, text in enumerate(texts):
        mine = slice(cuts[k], cuts[k + 1])
        merged: list[list[int]] = []
        if cuts[k] < cuts[k + 1]:
            stop = place[mine] + 1 - begins[k]
            spans = np.stack((stop - a.depth[end[mine]], stop), 1)
            for lo, hi in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
        out.append((len(numbers[k]), sum(hi - lo for lo, hi in merged), a.names(end[mine]), char_offsets(text, merged) if merged else []))
    return out


def scan(text: str, a: Automaton) -> tuple[int, int, set[str], list[list[int]]]:
    """:func:`scan_all` of one text."""
    return scan_all([text], a)[0]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int):
    """The benchmark in blocks of whole items, streamed, each of ``MAX_NODES`` nodes at most (one item may have more)."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("string"), text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        nodes = window * len(normal_words(r[1]))
        if block and size + nodes > MAX_NODES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += nodes
    if block:
        yield block


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", into: str = "hits"
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, item_ids and the character spans of the original text.

    Words are lower-cased in A-Z and hold ASCII letters, digits and all characters beyond ASCII. A word is hit if an
    occurrence of any window of an item covers it. Null texts and texts without words have no hits, as have all texts
    if the benchmark is empty; items without id, text or words are passed over; equal items count under each id.
    A benchmark of up to ``MAX_NODES / window`` words makes one automaton, which reads each text once; documents are scanned once against each block
    of a larger one, and the blocks' spans and items are merged. A column of ``docs`` called ``into`` is replaced.
    """
    docs = docs.drop(into)
    context, prior, out = docs.sparkSession.sparkContext, free_name(docs, "prior"), None
    for block in _blocks(benchmark, item_id, text, window):
        held = context.broadcast(automaton(block, window))  # MAX_NODES nodes, or those of one item
        out = _scan_block(docs if out is None else out.withColumnRenamed(into, prior), held, text, into, out is not None and prior)
    return _scan_block(docs, context.broadcast(automaton([], window)), text, into, None) if out is None else out


def _scan_block(docs: DataFrame, held, text: str, into: str, prior: str | None) -> DataFrame:
    names = [c for c in docs.columns if c != prior]

    def run(batches):
        a = held.value
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = b.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(b.schema.get_field_index(text)).to_pylist()]
                before = part.column(b.schema.get_field_index(prior)).to_pylist() if prior else [None] * len(texts)
                rows = []
                for t, had, (n, hit, ids, spans) in zip(texts, before, scan_all(texts, a), strict=True):
                    if had and had["n_hit"]:
                        hit, ids, spans = _merged(t, had, ids, spans)
                    rows.append({"n_words": n, "n_hit": hit, "item_ids": sorted(ids), "spans": spans})
                yield pa.RecordBatch.from_arrays([*(part.column(b.schema.get_field_index(c)) for c in names), pa.array(rows, _ARROW)], [*names, into])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField(into, HITS)]))


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int32())))])


def _merged(text: str, before: dict, ids: set[str], spans: list[list[int]]) -> tuple[int, set[str], list[list[int]]]:
    """The hits of earlier blocks and of this one, together."""
    joined: list[list[int]] = []
    for lo, hi in sorted([*before["spans"], *spans]):
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    return sum(len(normal_words(text[lo:hi])) for lo, hi in joined), ids | set(before["item_ids"]), joined


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their columns as they are. Null texts stay, and all without a benchmark; repeated rows fare alike."""
    into = free_name(docs, "hits")
    return benchmark_hits(docs, benchmark, window, into=into).where(F.col(into)["n_hit"] == 0).select(*docs.columns)
