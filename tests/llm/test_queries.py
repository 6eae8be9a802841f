"""The columns that SQL can express, against SQL."""

import duckdb
import pytest

from quarrymill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SIDES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.SIDES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
