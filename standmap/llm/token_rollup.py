"""Delta-maintained token totals by source, language and tokenizer version.

A batch of changes (insert, delete, revise) becomes signed rows; totals are their sums, so a batch adds to them
without a look at the rest of the corpus. The rows are kept by a hash of the document id, and what a deleted or revised
document has added so far is looked up in its own bucket only. A batch is committed once: its totals are written last,
and a batch whose totals are there is passed over when it comes again, after a crash or a replay. One writer at a time
holds a store's lock file. Many batches are merged into one by :meth:`Rollup.compact`, and stay known by name.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standmap.llm.common import BatchStore, materialize

#: Where the vocabulary is by default; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer that the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
#: Buckets of a new store's ledger, by document.
BUCKETS = 64
LEDGER = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(k, T.StringType()) for k in KEYS), *(T.StructField(s, T.LongType()) for s in SUMS)])


_PLACE = [T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())]


def _bucket(doc_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(buckets)).cast("int")


def load_encoding(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, version: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row of LEDGER for each row of ``docs`` (doc_id, source, lang, text): 1 document, its tokens and characters.

    Null and empty texts have none of either. Nulls in source and lang are kept as groups.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, about a megabyte

    def run(batches):
        encoding = load_encoding(ranks.value)
        for b in batches:
            texts = b.column(3).to_pylist()
            tokens = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            rest = [pa.array([version] * len(texts), pa.string()), pa.array([1] * len(texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *rest], LEDGER.names)

    held = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return held.mapInArrow(run, LEDGER)


class Rollup(BatchStore):
    """Token totals kept in ``store``, a folder that all executors reach.

    A new store gets ``buckets`` buckets, an old one keeps its own. A bucket of a batch is written by as many tasks as
    there are shuffle partitions for each, dealt out by a second hash, so that buckets don't bound the writers.
    """

    def __init__(self, spark: SparkSession, store: str, vocabularies: dict[str, str] | None = None, buckets: int = BUCKETS):
        super().__init__(spark, store)
        self.vocabularies = vocabularies or {"byte_bpe_50k/1": VOCABULARY}
        had = [int(n.removeprefix("buckets=")) for n in self._names("layout")]
        self.buckets = had[0] if had else buckets

    def _committed(self) -> list[str]:
        """Batches that make up the totals: those with whole totals that no compaction has merged."""
        whole = [n for n in self._names("totals") if self._is_whole(n)]
        merged = self._merged(whole)
        return [n for n in whole if n not in merged]

    def _is_whole(self, batch: str) -> bool:
        fs, at = self._path(f"totals/{batch}/_SUCCESS")
        return fs.exists(at)

    def _merged(self, whole: list[str]) -> set[str]:
        """Names of the batches in whole compactions: a name each, as the folders of batches are."""
        bases = [f"{self.store}/merged/{n}" for n in whole if n.startswith("base-")]
        return {r[0] for r in self.spark.read.text(bases).collect()} if bases else set()

    def _lay_out(self) -> None:
        fs, layout = self._path(f"layout/buckets={self.buckets}")
        fs.mkdirs(layout)

    def documents(self, buckets: list[int] | None = None) -> DataFrame:
        """What each document adds to the totals now, by id, source, language and tokenizer version; of some buckets only."""
        committed = self._committed()
        if not committed:
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(T.StructType([*LEDGER.fields, *_PLACE])).parquet(f"{self.store}/ledger").where(F.col("batch").isin(committed))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        now = rows.groupBy("doc_id", *KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))
        return now.where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """KEYS with n_docs, n_tokens and n_chars, over all committed batches; groups of no documents are left out."""
        schema = T.StructType([LEDGER[c] for c in (*KEYS, *SUMS)])
        paths = [f"{self.store}/totals/{b}" for b in self._committed()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS)).where("n_docs <> 0")

    def _write(self, batch: str, signed: DataFrame) -> None:
        """The ledger's rows of a batch, and last its totals, which commit it."""
        at = f"{self.store}/ledger/batch={batch}"
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        spread = F.pmod(F.xxhash64(F.lit("spread"), "doc_id"), F.lit(tasks))
        signed.withColumn("bucket", _bucket("doc_id", self.buckets)).repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(at)
        kept = self.spark.read.schema(T.StructType([*LEDGER.fields, _PLACE[1]])).parquet(at)
        kept.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS)).write.mode("overwrite").parquet(f"{self.store}/totals/{batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, text); false if ``batch`` has been committed before.

        ``delete`` takes away all that the document adds now, once however often it is named; ``insert`` adds a row;
        ``revise`` does both. Rows that repeat an insert count again. Deleting an unknown document changes nothing.
        Null ids are one document. Further columns are passed over. Batch names are letters, digits, ``_`` and ``-``, and
        don't begin with ``base-``. A second writer fails while one is at work.
        """
        if not re.fullmatch(r"(?!base-)[\w-]+", batch, re.ASCII):
            raise ValueError(f"no name for a batch: {batch!r}")
        with self._alone():
            self._lay_out()
            whole = [n for n in self._names("totals") if self._is_whole(n)]
            if batch in whole or batch in self._merged(whole):
                return False
            gone = materialize(changes.where("op in ('delete', 'revise')").select(F.col("doc_id").cast("long").alias("gone")).distinct(), "gone")
            touched = [r[0] for r in gone.select(_bucket("gone", self.buckets).alias("b")).distinct().collect()]  # numbers of buckets
            signed = self.spark.createDataFrame([], LEDGER)
            if touched:
                lost = self.documents(touched).join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi")
                signed = lost.select("doc_id", *KEYS, *((-F.col(s)).alias(s) for s in SUMS))
            for version, path in self.vocabularies.items():
                signed = signed.unionByName(counted(changes.where("op in ('insert', 'revise')"), version, path))
            self._write(batch, signed)
        return True

    def compact(self) -> str | None:
        """Merge the committed batches into one, ``base-<n>``, of a row for what each document adds; None if there are fewer than two.

        The merged names are written first and the base's totals last, which puts it in their place at once; then the
        merged folders go. A crash leaves either the batches or the base, and a base's folders that a crash has kept
        from going are passed over.
        """
        with self._alone():
            old = self._committed()
            if len(old) < 2:
                return None
            base = f"base-{1 + max((int(n[5:]) for n in self._names('merged')), default=0)}"
            known = sorted({*old, *self._merged([n for n in old if n.startswith("base-")])})
            self.spark.createDataFrame([(n,) for n in known], "value string").coalesce(1).write.mode("overwrite").text(f"{self.store}/merged/{base}")  # names of batches
            self._write(base, self.documents())
            for n in old:
                for name in (f"totals/{n}", f"ledger/batch={n}"):
                    fs, at = self._path(name)
                    fs.delete(at, True)
        return base
