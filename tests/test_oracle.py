"""Registered queries against DuckDB over the same tables."""

import os

import duckdb
import pytest

from transitmill import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v).removesuffix(" 00:00:00") if not isinstance(v, (int, bool)) and not hasattr(v, "dtype") else float(v) for v in df[c]]
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
