"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from lesograf.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    if sql := catalog.oracle_sql().get(name):
        found = db.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
