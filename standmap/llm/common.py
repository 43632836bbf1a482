"""Helpers shared by the text operators: written tables, ASCII tokens, values computed once a row."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from standmap.sources.store import materialize, scratch

__all__ = ["BatchStore", "ascii_lower", "discard", "free_name", "materialize", "once", "scratch", "words"]

#: Java pattern of a white-space delimited word, and of the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def discard(spark: SparkSession, df: DataFrame | None) -> None:
    """Remove the files of a table made by :func:`materialize` that nothing reads any more."""
    if df is None:
        return
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """White-space delimited words of a text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, computed once for a row however often ``then`` reads it, and wherever a plan moves it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class BatchStore:
    """A folder ``store`` that all executors reach, with one writer at a time, held by a lock file."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    @contextmanager
    def _alone(self):
        """Hold the store's lock file, which is created at once or not at all."""
        fs, at = self._path("_writer")
        fs.mkdirs(at.getParent())
        try:
            fs.create(at, False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer holds {at}; if it has died, release() the store") from e
        try:
            yield
        finally:
            fs.delete(at, False)

    def release(self) -> None:
        """Take away the lock of a writer that has died."""
        fs, at = self._path("_writer")
        fs.delete(at, False)
