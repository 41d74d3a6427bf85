"""Runs a query and its SQL over the same tables."""

import glob
import os

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return plain(list(value.asDict().values()))
    if isinstance(value, dict):
        return plain(list(value.values()))
    return value


def both(spark, query, sql):
    import duckdb

    got = query(spark, FOLDER)
    names = sorted(got.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in got.collect())
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    told = con.sql(sql)
    assert sorted(told.columns) == names
    at = [told.columns.index(c) for c in names]
    return mine, sorted(repr(tuple(plain(r[i]) for i in at)) for r in told.fetchall())
