"""Query results against DuckDB."""

import glob
import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool)) else str(v)


def connect(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def same(df, connection, sql):
    """Whether a DataFrame and a SQL result have the same columns and the same rows in any order."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(k)]) for k in order)) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[k]) for k in order)) for r in df.collect())
    return sorted(df.columns) == order and got == want
