"""Queries of the subpackage against their SQL, on the smallest tables."""

import duckdb
import pytest

from patternlake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, FOLDER).select(*sorted(want.columns))
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())
