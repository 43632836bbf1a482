"""Queries over the given tables, each with its DuckDB statement where SQL can state the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from standmap.sources.fixtures import Views, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Register a function of Views. ``views``: the views that ``sql`` names; ``sql`` may begin with WITH."""

    def put(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            body = sql.strip()
            head = ctes(*views.split())
            if head:
                start = "WITH RECURSIVE" if body.startswith("WITH RECURSIVE ") else "WITH"
                body = f"{start} {head},\n{body[len(start) + 1 :]}" if body.startswith("WITH ") else f"WITH {head}\n{body}"
            ORACLE[f.__name__] = body
        return f

    return put
