"""The operators that SQL can express against DuckDB on small tables."""

import os

import duckdb
import pytest

from objekta.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    df, found = QUERIES[name](spark, FOLDER), con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda names, values: sorted(repr([v[names.index(c)] for c in sorted(names)]) for v in values)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())
