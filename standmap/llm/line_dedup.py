"""Line dedup over overlapping three-line windows.

Consecutive lines are hashed in windows of three, windows that occur more than once anywhere are found, and every
later occurrence is removed by merging the lines that it covers. The first occurrence stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standmap.llm.common import free_name, materialize

WINDOW = 3
_WORDLESS = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    """(line, at): the lines that hold a word, with their places among all lines of the text."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    return F.filter(every, lambda x: x["line"].rlike(_WORDLESS))


def _place(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A row's place in the order of the corpus: by id, nulls last, then by a hash of the text."""
    return F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("t"))


def window_occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, at, key): each window's first line among the lines with words, and the 128-bit hash of its lines.

    Lines without a word belong to no window; texts of fewer than three lines with words, and null texts, have none.
    """
    held = docs.select(_place(docs, doc_id, text).alias("place"), F.transform(_lines(F.col(text)), lambda x: x["line"]).alias("w"))
    a, b, c = (lambda i: F.get("w", i)), (lambda i: F.get("w", i + 1)), (lambda i: F.get("w", i + 2))
    n = F.size("w") - (WINDOW - 1)
    keys = F.transform(F.slice("w", 1, F.greatest(n, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, b(i), c(i)).alias("h1"), F.xxhash64(F.lit(1), c(i), b(i), a(i)).alias("h2")))
    return held.where(n > 0).select("place", F.posexplode(keys).alias("at", "key"))


def later_occurrences(occurrences: DataFrame) -> DataFrame:
    """(place, spans): by document, the [from, to) ranges of lines with words that later occurrences cover.

    An occurrence that overlaps the first one of the same window, in the same document, covers only what lies behind it.
    """
    first = occurrences.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "at")).alias("first")).where("n > 1").drop("n")
    first = materialize(first, "first")  # so that both sides of the join are shuffled, and a hot window can be split
    later = occurrences.join(first, "key").where(F.struct("place", "at") > F.col("first"))
    lo = F.when(F.col("place") == F.col("first.place"), F.greatest("at", F.col("first.at") + WINDOW)).otherwise(F.col("at"))
    # a list has no more entries than its document has lines
    return later.select("place", F.struct(lo.alias("lo"), (F.col("at") + WINDOW).alias("hi")).alias("s")).groupBy("place").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "removed_lines") -> DataFrame:
    """``docs`` with later occurrences of repeated three-line windows cut from ``text``, and the number of lines cut.

    Windows are ordered by document id (null last), then a hash of the text, then line. Rows with equal id and text
    count as one document and fare alike. A text of which nothing is cut stays as it is, null and empty ones
    included; one whose lines are all cut becomes empty. An empty table gives an empty result. A column called
    ``into`` is replaced, all others stay.
    """
    docs = docs.drop(into)
    place, spans, gone = (free_name(docs, c) for c in ("place", "spans", "gone"))
    cut = later_occurrences(window_occurrences(docs, doc_id, text)).withColumnRenamed("place", place).withColumnRenamed("spans", spans)
    # the place as one value that is never null: a null id is held by its flag
    key = lambda p: F.concat_ws("|", p["n"].cast("string"), p["d"].cast("string"), p["t"].cast("string"))
    cut = cut.select(key(F.col(place)).alias(place), spans)
    out = docs.withColumn(place, key(_place(docs, doc_id, text))).join(cut, place, "left")
    # the places, among lines with words, that the spans cover, each once
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.when(s["hi"] > s["lo"], F.sequence(s["lo"], s["hi"] - 1)).otherwise(F.array().cast("array<int>")))))
    at = F.transform(_lines(F.col(text)), lambda x: x["at"])
    out = out.withColumn(gone, F.when(F.col(spans).isNotNull(), F.get(F.transform(F.array(at), lambda w: F.transform(covered, lambda i: F.get(w, i))), F.lit(0))))
    keep = F.array_join(F.get(F.transform(F.array(F.split(text, "\n", -1)), lambda every: F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(gone)), lambda i: F.get(every, i))), F.lit(0)), "\n")
    shown = [F.when(F.size(gone) > 0, keep).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*shown, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(into))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines cut, without those of which nothing is left, with their columns as they are.

    Null and empty texts that lose nothing stay; of equal texts the one of the least id stays whole, of repeated rows one.
    """
    into = free_name(docs, "removed_lines")
    out = dedup_lines(docs, into=into).where((F.col(into) == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(into) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
