"""Every query of the engine's own operators has the rows of its SQL."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from sparkmodel.project_queries import QUERIES
from sparkmodel.queries import SQL


def norm(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 9))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, list):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    duck.execute(SQL[name])
    columns = [d[0] for d in duck.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in duck.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
