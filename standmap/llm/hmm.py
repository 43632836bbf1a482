"""A hidden Markov language model, trained by Baum-Welch over the whole corpus, with exact forward scores.

A state emits a word class, the class a word: p(w) = B[state, class] * p(w | class). The SINGLES most frequent words are
classes of their own, so that states tell them apart; all others belong to a class by a hash of their last bytes, with
p(w | class) = (c(w) + 1) / (N_class + V_class + 1) from training counts, all unseen words of a class together counting
as one. As the second factor doesn't depend on the state, the forward recursion runs over classes, and the words' part
is a sum that joins with the table of counts. Each text ends with an end token of its own class.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standmap.llm.common import materialize

#: The model's size: hidden states, word classes, the bytes of a word's end that decide its class, and frequent words that
#: are classes of their own.
STATES, CLASSES, SUFFIX, SINGLES = 8, 4096, 4, 4096
ROUNDS = 5
#: Most words of highest count that every task holds; all others are looked up by a join. The result is the same for any value.
HEAD_WORDS = 65_536
#: Tokens that one step of the recursions handles at a time, and distinct words that a task counts before it passes them on.
STEP_TOKENS, HELD_WORDS = 400_000, 300_000
END = CLASSES


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then split at ASCII white space: what bytes.lower and bytes.split do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes) -> int:
    return crc32(word[-SUFFIX:]) % CLASSES


class _Numbers(dict):
    """Words numbered as they appear."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i

    def of(self, text: str | None) -> np.ndarray:
        w = tokens(text)
        return np.fromiter(map(self.__getitem__, w), np.int32, len(w))


def _word_counts(batches) -> Iterator[pa.RecordBatch]:
    def rows(numbers: _Numbers, times: np.ndarray) -> pa.RecordBatch:
        w = list(numbers)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([word_class(x) for x in w], pa.int32()), pa.array(times)], ["word", "class", "c"])

    numbers, waiting, size = _Numbers(), [], 0
    times = np.zeros(0, np.int64)

    def added() -> np.ndarray:
        now = np.bincount(np.concatenate(waiting), minlength=len(numbers)) if waiting else np.zeros(len(numbers), np.int64)
        now[: len(times)] += times
        return now

    for b in batches:
        for t in b.column(0).to_pylist():
            waiting.append(numbers.of(t))
            size += len(waiting[-1])
            if size >= STEP_TOKENS or len(numbers) >= HELD_WORDS:
                times, waiting, size = added(), [], 0
                if len(numbers) >= HELD_WORDS:
                    yield rows(numbers, times)
                    numbers, times = _Numbers(), np.zeros(0, np.int64)
    yield rows(numbers, added())


def count_words(texts: DataFrame) -> DataFrame:
    """(word, class, c) over the one text column of ``texts``; the end token is not among them."""
    return texts.mapInArrow(_word_counts, "word binary, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


class Model:
    """Start, transition and emission probabilities; ``words`` is log10 of each class's denominator."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, denominators: np.ndarray):
        self.start, self.move, self.emit, self.denominators = start, move, emit, denominators

    @classmethod
    def drawn(cls, class_tokens: np.ndarray, class_words: np.ndarray, states: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emit = (class_tokens + 1.0) * np.exp(rng.normal(0, 0.7, (states, len(class_tokens))))
        move = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), np.log10(class_tokens + class_words + 1.0))

    def learnt(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """The model of these expected counts, lightly smoothed so that no class is impossible."""
        share = lambda x, add: (x + add) / (x + add).sum(-1, keepdims=True)
        return Model(share(start, 0.1), share(move, 0.1), share(emit, 0.01), self.denominators)


def _groups(seqs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Indices by falling length, in groups of about STEP_TOKENS tokens (one sequence at least)."""
    lengths = np.array([len(s) for s in seqs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    cut = np.cumsum(lengths[order]) // STEP_TOKENS
    yield from np.split(order, np.flatnonzero(np.diff(cut)) + 1)


def _packed(seqs: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of sequences of falling length, by time step, and the number of sequences in each step."""
    lengths = np.array([len(seqs[i]) for i in at], np.int64)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    time = np.concatenate([np.arange(n) for n in lengths])
    first = np.concatenate(([0], np.cumsum(active)))[:-1]
    out = np.empty(lengths.sum(), np.int64)
    out[first[time] + np.repeat(np.arange(len(at)), lengths)] = np.concatenate([seqs[i] for i in at])
    return out, active


def log_likelihoods(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 of each class sequence's likelihood, by the scaled forward recursion."""
    out, emit = np.zeros(len(seqs)), np.ascontiguousarray(model.emit.T)
    for at in _groups(seqs):
        seq, active = _packed(seqs, at)
        lo, a, total = 0, None, np.zeros(len(at))
        for n in active.tolist():
            a = (np.broadcast_to(model.start, (n, len(model.start))) if a is None else a[:n] @ model.move) * emit[seq[lo : lo + n]]
            s = a.sum(1)
            a = a / s[:, None]
            total[:n] += np.log10(s)
            lo += n
        out[at] = total
    return out


def expected_counts(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions over class sequences."""
    k, c = model.emit.shape
    start, move, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    emit = np.ascontiguousarray(model.emit.T)
    for at in _groups(seqs):
        seq, active = _packed(seqs, at)
        ends = np.cumsum(active).tolist()
        active = active.tolist()
        e = emit[seq]
        alpha, scale = np.empty_like(e), np.empty(len(e))
        a, lo = None, 0
        for n, hi in zip(active, ends, strict=True):
            a = model.start * e[lo:hi] if a is None else (a[:n] @ model.move) * e[lo:hi]
            s = a.sum(1)
            a = a / s[:, None]
            alpha[lo:hi], scale[lo:hi] = a, s
            lo = hi
        e /= scale[:, None]
        back, hi = np.ones((active[-1], k)), ends[-1]
        gamma = alpha  # turned into posteriors in place, from the end
        for t in range(len(active) - 1, 0, -1):
            n, lo = active[t], hi - active[t]
            m = active[t - 1]
            w = e[lo:hi] * back
            move += gamma[lo - m : lo - m + n].T @ w
            gamma[lo:hi] *= back
            back = np.ones((m, k))
            back[:n] = w @ model.move.T
            hi = lo
        gamma[:hi] *= back
        start += gamma[:hi].sum(0)
        for i in range(k):
            emitted[i] += np.bincount(seq, weights=gamma[:, i], minlength=c)
    return start, move * model.move, emitted


def _sequences(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def baum_welch(sequences: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``model`` after ``rounds`` passes over ``sequences`` (one column of uint16 class sequences, as bytes).

    Each partition adds up its expected counts; Spark adds those, and (states + classes) * states numbers reach the
    driver. Without sequences the model stays as drawn.
    """
    spark = sequences.sparkSession
    k, c = model.emit.shape
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def expect(batches, now=now):
            total = np.zeros((k, 1 + k + c))
            for b in batches:
                if b.num_rows:
                    total += np.concatenate([x.reshape(k, -1) for x in expected_counts(now.value, _sequences(b.column(0)))], axis=1)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "x"])

        found = sequences.mapInArrow(expect, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(k * (1 + k + c))
        for r in found:
            total[r[0]] = r[1]
        if not found:
            return model
        total = total.reshape(k, -1)
        model = model.learnt(total[:, 0], total[:, 1 : 1 + k], total[:, 1 + k :])
        now.unpersist()
    return model


def _head(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words whose count reaches a threshold that ``most`` words at most reach."""
    steps = counts.groupBy(F.floor(4 * F.log2("c")).alias("step")).count().collect()  # some hundred rows at most
    least, total = None, 0
    for step, n in sorted(steps, reverse=True):
        if total + n > most:
            break
        least, total = step, total + n
    if least is None:
        return {}
    return {bytes(r[0]): r[1] for r in counts.where(F.floor(4 * F.log2("c")) >= least).select("word", "c").collect()}


_ENCODED = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("classes", T.BinaryType()),
        T.StructField("head_log", T.DoubleType()),
        T.StructField("head_known", T.LongType()),
        T.StructField("class_log", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
)


def _singles(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` words of highest count, and their counts."""
    return [(bytes(r[0]), r[1]) for r in counts.select("word", "c").orderBy(F.desc("c"), "word").limit(most).collect()]


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """``values`` as ``n`` lists; ``of`` says, in order, which list each one is in."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _encode(held: DataFrame, head: dict[bytes, int], singles: dict[bytes, int], denominators: np.ndarray) -> DataFrame:
    """Class sequences, the sums over words that every task knows, and how often each other word occurs in a text."""
    shared = held.sparkSession.sparkContext.broadcast((head, singles, denominators))

    def run(batches):
        head, singles, below = shared.value
        numbers, names = _Numbers(), []
        class_of, log_of = np.zeros(0, np.uint16), np.zeros(0)
        for b in batches:
            if len(numbers) >= HELD_WORDS:
                numbers, names = _Numbers(), []
                class_of, log_of = class_of[:0], log_of[:0]
            texts = [numbers.of(t) for t in b.column(3).to_pylist()]
            n, lengths = len(texts), np.array([len(x) for x in texts], np.int64)
            word, text = np.concatenate([np.zeros(0, np.int32), *texts]), np.repeat(np.arange(n), lengths)
            new = list(itertools.islice(numbers, len(names), None))
            names += new
            class_of = np.append(class_of, np.array([singles.get(w) or word_class(w) for w in new], np.uint16))
            log_of = np.append(log_of, np.log10([head.get(w, -1) + 1.0 or np.nan for w in new]))
            classes, logs = class_of[word], log_of[word]
            tail = np.isnan(logs)
            total = lambda x: np.bincount(text, weights=x, minlength=n).astype(np.float64)  # noqa: E731, B023
            sequences = np.full(len(word) + n, END, np.uint16)
            sequences[np.arange(len(word)) + text] = classes
            ends = 2 * np.concatenate(([0], np.cumsum(lengths + 1)))
            own, times = np.unique(text[tail] * len(names) + word[tail], return_counts=True)
            of = own // max(1, len(names))
            columns = [
                pa.array(lengths + 1),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(sequences)]),
                pa.array(total(np.where(tail, 0.0, logs))),
                pa.array(total(~tail).astype(np.int64)),
                pa.array(total(below[classes])),
                _lists(of, n, pa.array([names[i] for i in (own % max(1, len(names))).tolist()], pa.binary())),
                _lists(of, n, pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], _ENCODED.names)

    return held.mapInArrow(run, _ENCODED)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, seed: int = 5, head_words: int = HEAD_WORDS) -> DataFrame:
    """For every row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, logs to base 10.

    Held out are the rows whose crc32 of the id as text leaves 2 when divided by 7; a null id is not held out. The
    model learns from all others, whole texts, null ones as empty. ``base_score`` is the add-one unigram score with
    one slot for unseen words. Equal rows score alike; an empty table gives an empty result.
    """
    apart = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    held = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), apart.alias("held_out"), F.col(text).alias("text"))
    train = docs.where(~apart).select(F.col(text).alias("text"))
    counts = materialize(count_words(train), "counts")
    ends = train.count()
    per_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # CLASSES rows at most
    single = _singles(counts, SINGLES)
    n, v = np.zeros(CLASSES + 1 + len(single)), np.zeros(CLASSES + 1 + len(single))
    for r in per_class:
        n[r[0]], v[r[0]] = r[1], r[2]
    n[END], v[END] = ends, int(ends > 0)
    tokens_all, words_all = float(n.sum()), float(v.sum())
    for i, (w, c) in enumerate(single, END + 1):
        n[word_class(w)] -= c
        v[word_class(w)] -= 1
        n[i] = c  # and no other word in its class, unseen ones neither: its share there is 1
    model = Model.drawn(n, v, states, seed)
    singles = {w: i for i, (w, _) in enumerate(single, END + 1)}
    encoded = materialize(_encode(held, _head(counts, head_words) | dict(single), singles, model.denominators), "encoded")
    model = baum_welch(encoded.where("not held_out").select("classes"), model, rounds)
    final = docs.sparkSession.sparkContext.broadcast(model)

    def forward(batches):
        for b in batches:
            found = log_likelihoods(final.value, _sequences(b.column(b.schema.get_field_index("classes")))) if b.num_rows else np.zeros(0)
            keep = [i for i, c in enumerate(b.schema.names) if c != "classes"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(found)], [*(b.schema.names[i] for i in keep), "hidden_log"])

    kept = encoded.drop("words", "times")
    hidden = kept.mapInArrow(forward, T.StructType([*(f for f in kept.schema.fields if f.name != "classes"), T.StructField("hidden_log", T.DoubleType())]))
    tail = encoded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = tail.join(counts, "word").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("tail_log"), F.sum("times").alias("tail_known"))
    word_log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    end_log = float(np.log10(ends + 1.0))
    return hidden.join(sums, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(tokens_all)).cast("long").alias("train_tokens"),
        (word_log + end_log - F.col("n_tokens") * float(np.log10(tokens_all + words_all + 1.0))).alias("base_score"),
        # the end token is alone in its class, so its share there is 1
        (F.col("hidden_log") + word_log - F.col("class_log")).alias("score"),
    )
