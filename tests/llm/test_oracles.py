"""The queries that SQL can express, against it."""

import duckdb
import pytest

from reelspan.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(r) for r in found), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())
