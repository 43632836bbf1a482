"""Quality rules as a short-circuit cascade ordered by rejection per cost. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standmap.llm.common import free_name, once, words

#: Rows, about, on which rejection and cost are estimated. They decide the order of rules alone.
SAMPLE_ROWS = 500


def lines(text: Column) -> Column:
    """Lines that hold a word; none for null."""
    return F.coalesce(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.array().cast("array<string>"))


#: What features are made of, by name: ``text``, and ``words`` and ``lines`` of it.
Held = Mapping[str, Column]
SHARED: dict[str, Callable[[Column], Column]] = {"words": words, "lines": lines}


def n_words(held: Held) -> Column:
    return F.size(held["words"]).cast("long")


def word_chars(held: Held) -> Column:
    """Code points in words."""
    return F.length(F.array_join(held["words"], "")).cast("long")


def n_symbols(held: Held) -> Column:
    return F.coalesce(F.length(held["text"]) - F.length(F.regexp_replace(held["text"], r"[#*$%&|<>]", "")), F.lit(0)).cast("long")


def n_lines(held: Held) -> Column:
    return F.size(held["lines"]).cast("long")


def n_dup_lines(held: Held) -> Column:
    """Lines with a word that equal an earlier line."""
    return (F.size(held["lines"]) - F.size(F.array_distinct(held["lines"]))).cast("long")


def n_repeat_words(held: Held) -> Column:
    """Words in 3-word windows that are found twice or more in the text, first ones included.

    Windows are sorted by hash, those with an equal neighbour kept, and the words that their starts cover counted.
    """

    def starts(v: Column) -> Column:
        return F.sort_array(F.transform(F.slice(v, 1, F.greatest(F.size(v) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2)).alias("h"), i.alias("p"))))

    def repeated(s: Column) -> Column:
        equal = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x["p"]))

    def covered(r: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(r, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return once(held["words"], lambda v: once(starts(v), lambda t: covered(repeated(t)))).cast("long")


def n_letterless(held: Held) -> Column:
    """Words without a letter: all but those that a pattern for words with one finds."""
    return (F.size(held["words"]) - F.coalesce(F.regexp_count(held["text"], F.lit(r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+")), F.lit(0))).cast("long")


def crowded(held: Held) -> Column:
    """1 if more than a fifth of the words are the same one, else 0.

    That word has a run of n / 5 + 1 places in the sorted hashes, so some hash equals the one n / 5 places behind it.
    """
    step = lambda s: F.floor(F.size(s) / 5).cast("int")
    far = lambda s: F.exists(F.sequence(F.lit(0), F.size(s) - 1 - step(s)), lambda i: F.get(s, i) == F.get(s, i + step(s)))
    return F.when(F.size(held["words"]) > 0, once(F.sort_array(F.transform(held["words"], lambda x: F.xxhash64(x))), far)).otherwise(F.lit(False)).cast("long")


FEATURES: dict[str, Callable[[Held], Column]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letterless, crowded)}
#: Which of :data:`SHARED` a feature reads.
READS = {"n_words": ("words",), "word_chars": ("words",), "n_symbols": (), "n_lines": ("lines",), "n_dup_lines": ("lines",), "n_repeat_words": ("words",), "n_letterless": ("words",), "crowded": ("words",)}
#: Steps that each takes, in (passes over characters, passes over words, times that words are sorted).
STEPS = {
    "words": (4, 0, 0), "lines": (2, 0, 0), "n_words": (0, 0, 0), "word_chars": (1, 1, 0), "n_symbols": (2, 0, 0), "n_lines": (0, 0, 0), "n_dup_lines": (1, 0, 0),
    "n_repeat_words": (1, 8, 2), "n_letterless": (4, 0, 0), "crowded": (1, 2, 1),
}
#: The features of the first rules, which cost a pass over the text each.
BASE_FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Words from which a share of the words says something about a text.
ENOUGH = 50


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails``, given its features by name, is true."""

    name: str
    features: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


def rules(least_words: int = 50) -> tuple[Rule, ...]:
    """The rules, for texts of ``least_words`` words or more."""
    return (
        Rule("few_words", ("n_words",), lambda f: f["n_words"] < least_words),
        Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
        Rule("many_symbols", ("n_symbols", "n_words"), lambda f: f["n_symbols"] > f["n_words"]),
        Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda f: 10 * f["n_dup_lines"] > 3 * f["n_lines"]),
        Rule("odd_word_length", ("word_chars", "n_words"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 25 * f["n_words"])),
        Rule("letterless_words", ("n_words", "n_letterless"), lambda f: (f["n_words"] >= ENOUGH) & (10 * f["n_letterless"] > 3 * f["n_words"])),
        Rule("one_word", ("n_words", "crowded"), lambda f: (f["n_words"] >= ENOUGH) & (f["crowded"] > 0)),
    )


RULES = rules()


def with_features(docs: DataFrame, names: list[str] | tuple[str, ...] = tuple(FEATURES), text: str = "text", held: Mapping[str, str] | None = None) -> DataFrame:
    """``docs`` with the named features as long columns; a null text counts as empty. Columns so called are replaced.

    ``held``: columns of ``docs`` that have its words or lines already. What isn't held is made once a row.
    """
    out, at = docs.drop(*(set(names) - {text})), dict(held or {})
    more = [s for s in SHARED if s not in at and any(s in READS[n] for n in names)]
    for s in more:
        at[s] = free_name(out, s)
        out = out.withColumn(at[s], SHARED[s](F.col(text)))
    values = {"text": F.col(text)} | {s: F.col(c) for s, c in at.items()}
    return out.select(*(c for c in out.columns if c not in [at[s] for s in more]), *(FEATURES[n](values).alias(n) for n in names))


def _cost(rule: Rule, given: tuple[str, ...], chars: Column, n: Column) -> Column:
    """Steps that a rule takes on a text of so many characters and words, of which ``given`` features and values take none."""
    own = [f for f in rule.features if f not in given]
    parts = [STEPS[x] for x in {*own, *(s for f in own for s in READS[f] if s not in given)}]
    a, b, c = (sum(x) for x in zip((0, 0, 0), *parts, strict=True))
    return 1 + a * chars + n * (b + c * F.log2(n + 2))


def calibrate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text", given: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """Rules with their rejected share and steps per row on a sample, by rejection per cost, best first, then by name.

    Steps are counted, not timed, so that equal tables give equal orders. The sample is a seeded draw of about ``rows``
    rows out of all, of whole texts; only its sums reach the driver. Features and values that are ``given`` cost nothing.
    It decides only the order of evaluation: a document is kept if no rule fails it, in any order. An empty sample leaves
    the order as given.
    """
    short = docs.select(F.col(text).alias("text"))
    sample = short.sample(False, min(1.0, rows / max(1, docs.count())), 17)
    n, chars = F.col("n_words").cast("double"), F.coalesce(F.length("text"), F.lit(0)).cast("double")
    f = with_features(sample, tuple(FEATURES))
    named = {x: F.col(x) for x in FEATURES}
    sums = f.agg(F.count(F.lit(1)), *(x for r in rules for x in (F.sum(r.fails(named).cast("int")), F.sum(_cost(r, given, chars, n))))).first()
    if not sums[0]:
        return [(r, 0.0, 0.0) for r in rules]
    found = [(r, sums[1 + 2 * i] / sums[0], sums[2 + 2 * i] / sums[0]) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def first_failure(order: list[Rule] | tuple[Rule, ...], held: Held, given: Held) -> Column:
    """Name of the first rule in ``order`` that fails a document, else null.

    Later branches are not evaluated. Words and lines are made where the first rule that reads them stands, once, for
    it and all that follow.
    """
    if not order:
        return F.lit(None).cast("string")
    rule = order[0]
    for s in (s for n in rule.features if n not in given for s in READS[n] if s not in held):
        return once(SHARED[s](held["text"]), lambda v: first_failure(order, {**held, s: v}, given))
    values = {n: given[n] if n in given else FEATURES[n](held) for n in rule.features}
    return F.when(rule.fails(values), rule.name).otherwise(first_failure(order[1:], held, given))


def quality_cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None, text: str = "text", into: str = "failed_rule", given: tuple[str, ...] = (), held: Mapping[str, str] | None = None
) -> DataFrame:
    """``docs`` with ``into``: the first rule that fails a document, null if it passes all of them.

    Rules go by :func:`calibrate`'s order, equal ones by name, so that of several rules that fail a text the same one is
    named each time on the same table. Words, lines and features are made in the branch that needs them, so a document
    leaves the cascade at its first failure; features ``given``, and words or lines ``held`` in a column, are at hand
    already. Null and empty texts have no words; equal rows fare alike; an empty table gives an empty result. A column
    called ``into`` is replaced, all others stay.
    """
    held = held or {}
    order = order or [r for r, _, _ in calibrate(docs, rules, text=text, given=(*given, *held))]
    failed = first_failure(order, {"text": F.col(text)} | {s: F.col(c) for s, c in held.items()}, {n: F.col(n) for n in given})
    return docs.drop(*({into} - {text})).withColumn(into, failed)


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, with their columns as they are.

    Null texts count as empty, equal rows stay or go together, and an empty table stays empty.
    """
    into = free_name(docs, "failed_rule")
    return quality_cascade(docs, rules, into=into).where(F.col(into).isNull()).select(*docs.columns)
