"""Runs a query and its SQL on the same tables and compares rows."""

import math
import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) if not math.isinf(v) else v
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def key(row) -> str:
    return repr(tuple(int(x) if isinstance(x, float) and x == int(x) else x for x in row))


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    spark_rows = sorted(key(plain(tuple(r[c] for c in cols))) for r in df.collect())
    sql_rows = sorted(key(plain(tuple(r[i] for i in at))) for r in rel.fetchall())
    assert spark_rows == sql_rows
