"""Queries against their SQL on the given tables."""

import duckdb
import pandas as pd
import pytest
from flowspark.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    want, got = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
