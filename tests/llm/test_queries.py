"""The registered queries of this subpackage against their SQL in DuckDB."""

import os

import duckdb
import pytest

from tessera.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in cur.description)
    want = sorted((tuple(dict(zip([d[0] for d in cur.description], r))[n] for n in names) for r in cur.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    got = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    assert got and got == want
