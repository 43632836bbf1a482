"""From raw documents to pieces: quality rules, line dedup, SimHash near-dedup, decontamination, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from standmap.llm.common import materialize
from standmap.llm.decontaminate import drop_contaminated
from standmap.llm.line_dedup import keep_first_lines
from standmap.llm.piece_dropout import encode_pieces
from standmap.llm.quality import keep_quality, rules
from standmap.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some rule rejects go; short ones stay, if they have a word. Null texts and texts without a word go; equal rows fare alike."""
    return keep_quality(docs, rules(least_words=1))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; documents of which nothing is left go. Of equal texts the one of the least id stays whole; null texts stay null."""
    return keep_first_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id; of repeated rows one. Null and wordless texts are one group."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null texts hold none; without a benchmark all stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, which decode to the text. A null text has null ids, an empty one none; repeated rows get equal pieces."""
    return encode_pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: BPE pieces and XXH64 fingerprints are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
