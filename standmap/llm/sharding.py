"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn from the multivariate hypergeometric law,
row by row of the matrix, so that the shard sizes come out exact and the whole is distributed as a uniform
shuffle. Each partition permutes its rows against its row of the matrix, rows are exchanged, and each shard is
permuted again to give every row its slot.

Only counts reach the driver: one per input partition, shards per partition for the matrix, and one per
permutation bin (``MAX_BINS`` at most).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from standmap.llm.common import free_name, materialize

#: Rows that one task permutes in the second pass, and the most bins that the second pass may have.
ROWS_PER_BIN = 50_000
MAX_BINS = 65_536


def shard_sizes(n_rows: int, n_shards: int) -> np.ndarray:
    """Shard sizes that differ by one at most."""
    return np.array([n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)], dtype=np.int64)


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows: input partitions. Columns: shards. Row sums are ``counts``, column sums the shard sizes."""
    left = shard_sizes(sum(counts), n_shards)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    for p, n in enumerate(counts):
        if n:
            out[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
            left -= out[p]
    return out


def hypergeometric_shards(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """``docs`` with ``shard`` int, 0 to ``n_shards - 1``, and ``slot`` long, gapless from 0 in each shard.

    Every row is dealt, nulls, equal rows and rows without text included; shard sizes differ by one at most and
    every assignment is equally likely. An empty table gives an empty result. Columns of ``docs`` called
    ``shard`` or ``slot`` are replaced. Rows are kept in the shared folder once, so that a lost executor
    redraws the same numbers.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    docs = docs.drop("shard", "slot")
    spark, columns = docs.sparkSession, docs.columns
    rid, part, at, key, bin_, base = (free_name(docs, c) for c in ("rid", "part", "at", "key", "bin", "base"))
    kept = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    # the id holds the partition in its upper bits and the position in that partition in its lower 33 bits
    rows = kept.withColumn(part, F.shiftright(rid, 33).cast("int")).withColumn(at, F.col(rid).bitwiseAND((1 << 33) - 1))
    found = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    matrix = spark.sparkContext.broadcast(communication_matrix(counts, n_shards, seed))

    def deal(batches):
        """Appends shard and key to batches that end with the partition and the position."""
        p, labels, keys = -1, None, None
        for b in batches:
            parts, i = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            shard, rnd = np.zeros(len(i), np.int32), np.zeros(len(i), np.int64)
            for q in np.unique(parts):
                if q != p:
                    p, rng = int(q), np.random.default_rng([seed, int(q), 1])
                    labels = rng.permutation(np.repeat(np.arange(n_shards, dtype=np.int32), matrix.value[p]))
                    keys = rng.integers(0, 1 << 62, size=len(labels), dtype=np.int64)
                mine = parts == q
                shard[mine], rnd[mine] = labels[i[mine]], keys[i[mine]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(rnd)], [*b.schema.names, "shard", key])

    n_bins = int(min(MAX_BINS // n_shards + 1, -(-sum(counts) // (ROWS_PER_BIN * n_shards)) or 1))

    def dealt(frame: DataFrame) -> DataFrame:
        schema = T.StructType([*frame.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(key, T.LongType())])
        return frame.mapInArrow(deal, schema).withColumn(bin_, F.shiftright(key, 40) % n_bins)

    sizes = {(r[0], r[1]): r[2] for r in dealt(rows.select(part, at)).groupBy("shard", bin_).count().collect()}
    starts = []
    for s in range(n_shards):
        total = 0
        for b in range(n_bins):
            starts.append((s, b, total))
            total += sizes.get((s, b), 0)
    # MAX_BINS + n_shards rows at most
    offsets = F.broadcast(spark.createDataFrame(starts, f"shard int, `{bin_}` long, `{base}` long"))
    within = Window.partitionBy("shard", bin_).orderBy(key, part, at)
    placed = dealt(rows.select(*columns, part, at)).join(offsets, ["shard", bin_])
    return placed.select(*columns, "shard", (F.col(base) + F.row_number().over(within) - 1).alias("slot"))
