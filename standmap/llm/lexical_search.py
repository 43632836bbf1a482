"""Ranked lexical search by the Best Position Algorithm.

Documents are kept with their counts of the queries' terms. A shard of them has, for each term, a list of its documents
by falling impact; a query goes down its terms' lists side by side. Each document met there is looked up at once in all
the query's lists (a direct access), which gives its whole score and marks its position in every list. The best position
of a list is the last one before which nothing is unmarked, often far below the last one read, and the impacts at the
best positions bound the score of all documents not met. The search of a shard stops when that bound is strictly below
the k-th best score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from standmap.llm.common import materialize
from standmap.llm.decontaminate import normal_words

#: Distinct terms of the queries that are searched for together; more queries follow in blocks of whole ones.
TERMS = 500_000
#: Postings that a shard holds, and positions of each list that a query reads first.
SHARD, FIRST = 2_000_000, 16
#: Groups in which the documents found for a query are ranked before they meet.
SALT = 256


def _blocks(queries: DataFrame, item_id: str, text: str):
    """(terms, items) of blocks of whole queries, streamed: a term's number, and an item's id and sorted term numbers."""
    terms: dict[bytes, int] = {}
    items: dict[object, set[int]] = {}
    for key, words in queries.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).orderBy(item_id).toLocalIterator():
        if len(terms) >= TERMS and key not in items:
            yield terms, items
            terms, items = {}, {}
        if found := {terms.setdefault(w, len(terms)) for w in normal_words(words)}:
            items.setdefault(key, set()).update(found)
    if items:
        yield terms, items


def count_terms(docs: DataFrame, terms: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): how many terms a document has in all, and the numbers and counts of those in ``terms``.

    A term is a maximal run of digits, letters and characters beyond ASCII, A-Z in lower case. Null texts have none.
    """
    held = docs.sparkSession.sparkContext.broadcast(terms)  # TERMS terms and those of one query

    def run(batches):
        number = held.value
        for ids, texts in batches:
            n, at, tf, lengths = [], [], [], []
            for t in texts.to_pylist():
                w = normal_words(t or "")
                known, counts = np.unique(np.fromiter((i for i in map(number.get, w) if i is not None), np.int32), return_counts=True)
                n.append(len(w))
                at.append(known)
                tf.append(counts)
                lengths.append(len(known))
            ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, k), *x]).astype(k))) for x, k in ((at, np.int32), (tf, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], [doc_id, "n", "terms", "tf"])

    schema = T.StructType([docs.schema[doc_id], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    return docs.select(doc_id, text).mapInArrow(run, schema)


class Shard:
    """Impact lists over some documents, numbered by id; nulls come last."""

    def __init__(self, ids: pa.Array, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        self.ids = ids.take(pa.array(order))
        doc = np.empty(len(order), np.int64)
        doc[order] = np.arange(len(order))
        m = 10 + (90 * n * n_docs) // max(n_terms, 1)
        keep = weight[terms] > 0  # a term without weight adds nothing
        of = np.repeat(np.arange(len(n)), lengths)[keep]
        terms, tf = terms[keep], tf[keep]
        impact, at = (1_000_000_000 * tf) // (1000 * tf + 8 * m[of]), doc[of]
        by = np.lexsort((at, -impact, terms))
        self.docs, self.impacts = at[by], impact[by]
        self.first = np.searchsorted(terms[by], np.arange(len(weight) + 1))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        by = np.argsort(at, kind="stable")
        #: for direct accesses: by document, the term, its impact, and its place among all lists' positions
        self.term, self.impact, self.place = terms[by], impact[by], place[by]
        self.start = np.searchsorted(at[by], np.arange(len(order) + 1))
        self.weight, self.slot = weight, np.full(len(weight), -1, np.int64)

    def search(self, query: np.ndarray, k: int, floor: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, positions read) of the ``k`` best of score 1 or more, equal scores by document.

        ``floor``: how many scores this shard's documents must reach are known already, and the k-th best of them; scores
        below may be left out.
        """
        query = query[self.first[query + 1] > self.first[query]]
        if not len(query):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        first, stop, weight = self.first[query], self.first[query + 1], self.weight[query]
        self.slot[query] = np.arange(len(query))
        offset = np.concatenate(([0], np.cumsum(stop - first)))
        seen, best = np.zeros(offset[-1], bool), np.zeros(len(query), np.int64)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        met, read, width = np.zeros(len(self.ids), bool), 0, FIRST
        kth = floor[1] if floor[0] >= k else 0
        while True:
            new = np.unique(np.concatenate([self.docs[a:b] for a, b in zip(np.minimum(first + read, stop), np.minimum(first + read + width, stop), strict=True)]))
            new = new[~met[new]]
            read, width = read + width, 2 * width
            met[new] = True
            # direct accesses: all postings of the new documents, of which the query's count
            n = self.start[new + 1] - self.start[new]
            at = np.arange(n.sum()) + np.repeat(self.start[new] - (np.cumsum(n) - n), n)
            slot = self.slot[self.term[at]]
            own = slot >= 0
            at, slot, of = at[own], slot[own], np.repeat(np.arange(len(new)), n)[own]
            total = np.zeros(len(new), np.int64)
            np.add.at(total, of, weight[slot] * self.impact[at])
            seen[offset[slot] + self.place[at] - first[slot]] = True
            reached = total >= max(kth, 1)
            docs, scores = np.concatenate((docs, new[reached])), np.concatenate((scores, total[reached]))
            if len(docs) > k:
                keep = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[keep], scores[keep]
            if len(docs) >= k:
                kth = max(kth, int(scores.min()))
            bound = 0
            for s in range(len(query)):
                lo, hi = offset[s] + best[s], offset[s + 1]
                if lo < hi:
                    gap = int(seen[lo:hi].argmin())
                    best[s] = hi - offset[s] if seen[lo + gap] else best[s] + gap
                if best[s] < hi - offset[s]:
                    bound += int(weight[s] * self.impacts[first[s] + best[s] - 1])
            if bound < kth or bound == 0 or (first + read >= stop).all():
                break
        self.slot[query] = -1
        order = np.lexsort((docs, -scores))
        return docs[order], scores[order], int(np.minimum(read, stop - first).sum())


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _searched(counts: DataFrame, items: dict, weight: np.ndarray, n_docs: int, n_terms: int, k: int, item_type: T.DataType, doc_id: str) -> DataFrame:
    """(item_id, doc_id, score): for each item the ``k`` best documents of each task."""
    keys = list(items)
    held = counts.sparkSession.sparkContext.broadcast((keys, [np.array(sorted(items[x]), np.int64) for x in keys], weight))  # a block of queries

    def run(batches):
        keys, queries, weight = held.value
        floors: list[np.ndarray] = [np.zeros(0, np.int64)] * len(keys)

        def found(parts):
            ids = pa.concat_arrays([p.column(0) for p in parts])
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            lengths = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
            terms, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in (2, 3))
            shard = Shard(ids, n, lengths, terms.astype(np.int64), tf, weight, n_docs, n_terms)
            which, docs, scores = [], [], []
            for q, query in enumerate(queries):
                floor = floors[q]
                d, s, _ = shard.search(query, k, (len(floor), int(floor[-1]) if len(floor) else 0))
                floors[q] = np.sort(np.concatenate((floor, s)))[::-1][:k]
                which += [q] * len(d)
                docs.append(d)
                scores.append(s)
            out = shard.ids.take(pa.array(np.concatenate(docs)))
            return pa.RecordBatch.from_arrays([pa.array([keys[q] for q in which], item_arrow), out, pa.array(np.concatenate(scores))], ["item_id", doc_id, "score"])

        parts, size = [], 0
        for b in batches:
            parts.append(b)
            size += len(b.column(2).flatten()) + b.num_rows
            if size >= SHARD:
                yield found(parts)
                parts, size = [], 0
        if parts:
            yield found(parts)

    item_arrow = to_arrow_type(item_type)
    schema = T.StructType([T.StructField("item_id", item_type), counts.schema[doc_id], T.StructField("score", T.LongType())])
    return counts.where(F.size("terms") > 0).mapInArrow(run, schema)


def _best(found: DataFrame, k: int, doc_id: str) -> DataFrame:
    """The ``k`` best of each item, first within salted groups, so that no task gets what all tasks found for an item."""
    order = [F.desc("score"), F.asc_nulls_last(doc_id)]
    salt = F.pmod(F.xxhash64(doc_id), F.lit(SALT))
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", salt).orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)  # SALT * k rows


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each query the ``k`` documents of highest score above 0, or all, if fewer.

    A query's score in a document adds up, over its distinct terms, a weight, floor(1000 * ln((2N + 2) / (2df + 1))),
    times (10^9 tf) div (1000 tf + 8m) with m = 10 + (90 n N) div L: N documents with a term, L terms in all, n terms of
    the document. Equal scores go by doc_id, null last. Each row of ``docs`` is a document, repeated rows too; null and
    wordless texts are none. Rows of one item are one query; those without id or text are passed over, and without
    queries or documents there are no rows. Queries of more than ``TERMS`` distinct terms are searched in blocks, each a
    pass over the documents; all rows are searched for all queries.
    """
    out, spark = None, docs.sparkSession
    item_type = queries.schema[item_id].dataType
    for terms, items in _blocks(queries, item_id, query_text):
        counts = materialize(count_terms(docs, terms, doc_id, text), "terms")
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # a row a term
            df[term] = n
        found = _best(_searched(counts, items, _weights(df, n_docs), n_docs, n_terms, k, item_type, doc_id), k, doc_id)
        found = found.select(F.col("item_id").alias(item_id), "rank", doc_id, "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([queries.schema[item_id], T.StructField("rank", T.IntegerType()), docs.schema[doc_id], T.StructField("score", T.LongType())]))
    return out
