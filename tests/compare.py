"""Rows of a query and of its SQL in one comparable form."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import duckdb
from check import TABLES, rows_of


def same(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            path = f"{folder}/{t}.parquet"
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0]
    assert got[1] == want[1]
