"""Registered queries of the subpackage against their SQL in DuckDB."""

import duckdb
import pytest

from quarry.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    key = got.columns[0]
    got, want = (df[sorted(df.columns)].sort_values(key).reset_index(drop=True).astype(str) for df in (got, want))
    assert got.equals(want)
