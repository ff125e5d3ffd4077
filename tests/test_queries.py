"""Every registered query against its SQL twin on the smallest given tables."""

import functools

import duckdb
import pytest

import __spark_entry__ as entry_points
from sentrylake.plans import catalog_detect
from sentrylake.plans.registry import QUERIES as OWN
from tools.check import TABLES, norm

QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()
# The training-data queries have their own tests.
NAMES = sorted(OWN)


@pytest.fixture(scope="module", autouse=True)
def one_detection():
    """Queries over the result of a whole detection share one run of it."""
    original = catalog_detect._detected
    catalog_detect._detected = functools.cache(original)
    yield
    catalog_detect._detected = original


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    pick = [rel.columns.index(c) for c in columns]
    expected = sorted(repr(tuple(norm(r[i]) for i in pick)) for r in rel.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in columns)) for r in rows) == expected


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert "detection_type" in df.columns


def test_every_query_with_a_twin():
    assert set(ORACLE) <= set(QUERIES)
