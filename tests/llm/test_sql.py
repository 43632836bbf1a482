"""Text queries that SQL can express, against their DuckDB SQL over whole tables."""

import pytest

from standmap.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
