"""Every query with SQL against DuckDB on small tables."""

import math
import os

import duckdb
import pytest

from objekta.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    found = tables.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"special_functions"}
