"""The shared scratch folder, written tables, and numbering of globally ordered rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_made: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor can reach; the application's folder goes at its end.

    Where the session names no such folder, a temporary one is made, on a single machine only.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("standmap.scratch", None)
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="standmap-")
        spark.conf.set("standmap.scratch", base)
    top = f"{base.rstrip('/')}/standmap/{context.applicationId}"
    if top not in _made:
        path = context._jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(top)
    return f"{top}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends, a lost executor costs nothing."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by columns, into ``standmap.parts`` parts where the session sets that number, else by Spark's own."""
    n = df.sparkSession.conf.get("standmap.parts", None)
    return df.repartition(int(n), *by) if n else df.repartition(*by)


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums, current row included, in the global order ``order``, which should be total.

    Rows are range-partitioned and summed within partitions; only one total per partition reaches the driver, so no
    task holds all rows.
    """
    named = {f"__v_{n}": c for n, c in sums.items()}
    kept = materialize(df.withColumns(named).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    totals = kept.groupBy("__p").agg(*(F.sum(v).alias(v) for v in named)).collect()
    rows, before = [], [0] * len(named)
    for r in sorted(totals):
        rows.append((r[0], *before))
        before = [b + (x or 0) for b, x in zip(before, r[1:], strict=True)]
    kinds = dict(kept.dtypes)
    wide = {v: "double" if kinds[v] in ("double", "float") else "bigint" for v in named}
    schema = ", ".join(["__p int", *(f"{v}_0 {wide[v]}" for v in named)])
    rows = [(r[0], *(float(x) if wide[v] == "double" else int(x) for v, x in zip(named, r[1:], strict=True))) for r in rows]
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a row per partition
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(offsets, "__p").withColumns({n: F.col(f"__v_{n}_0") + F.sum(f"__v_{n}").over(w) for n in sums})
    return out.drop("__p", *named, *(f"{v}_0" for v in named))


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the global order ``order``."""
    return running_sums(df, order, {name: F.lit(1).cast("long")})


def quantiles(df: DataFrame, value: str, at: Sequence[float], into: str = "q") -> DataFrame:
    """One row: ``into``, the quantiles ``at`` of the known values of ``value``, interpolated linearly; nulls if there are none.

    Equal values are counted first and the counts summed up in order, so no task holds all values.
    """
    g = running_sums(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), ["v"], {"c": F.col("n")})
    last = g.agg((F.max("c") - 1).alias("last"))
    rows = g.crossJoin(F.broadcast(last))  # one row
    found = []
    for x in at:
        place = F.col("last") * F.lit(float(x))
        low, high = (F.min(F.when(F.col("c") > f(place), F.col("v"))) for f in (F.floor, F.ceil))
        found.append(low + (high - low) * F.max(place - F.floor(place)))
    return rows.agg(F.array(*found).alias(into))
