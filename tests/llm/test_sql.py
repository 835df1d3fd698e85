"""The corpus operators' queries give their SQL's rows."""

import os

import duckdb
import pytest

from corvid.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, expected = registry.queries()[name](spark, DATA), con.sql(registry.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    plain = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in expected.fetchall())
