"""The registered queries: all eleven are there, and those with SQL have its rows."""

import glob
import os

import duckdb

import __spark_entry__ as entry


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_sql_twins(spark, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            df = entry.queries()[name](spark, sf_dir)
            con.execute(sql)
            columns = [d[0] for d in con.description]
            assert sorted(df.columns) == sorted(columns)
            expected = sorted((tuple(r[columns.index(c)] for c in df.columns) for r in con.fetchall()), key=str)
            assert sorted(map(tuple, df.collect()), key=str) == expected
