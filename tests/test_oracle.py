"""Every query with SQL against DuckDB on the smallest tables, and those that round means of counts on larger ones too."""

import decimal
import math
import os

import pytest

from standmap.plans import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose means of counts over windows or groups may be ties of the last digit.
ROUNDED = ("box_stats", "gap_and_damage_map", "stress_map", "crop_summary", "label_coverage", "slice_report")


def tables(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.fixture(scope="module")
def larger():
    return tables(LARGER)


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def compare(name, spark, con, sf):
    df = QUERIES[name](spark, sf)
    want = con.sql(ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, con):
    compare(name, spark, con, SF)


@pytest.mark.parametrize("name", ROUNDED)
def test_rounded_query_equals_sql_on_larger_tables(name, spark, larger):
    compare(name, spark, larger, LARGER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
