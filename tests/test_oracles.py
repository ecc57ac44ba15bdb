"""Every registered library query against its SQL twin in DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quarry.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"girvan_newman", "rfe_select", "cv_search", "bfr_cluster"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracles()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles()) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
