"""Spark-vs-DuckDB result comparison (the local twin of the driver's gate).

Rows are compared order-insensitively after sorting columns by name;
floats are rounded to 6 places, timestamps compared as text.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float | np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 6)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime | dt.date):
        return str(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    out.sort(key=repr)
    return [cols[i] for i in order], out


def digest(rows):
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]




def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(sdf, con, sql: str) -> tuple[bool, str]:
    """Run both sides; return (equal, short report)."""
    sc, sr = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(sql)
    dc, dr = rows_of([c[0] for c in res.description], res.fetchall())
    if sc != dc:
        return False, f"columns differ: {sc} vs {dc}"
    if len(sr) != len(dr):
        return False, f"row counts differ: {len(sr)} vs {len(dr)}"
    if digest(sr) != digest(dr):
        ss, ds = set(sr), set(dr)
        return False, f"values differ: spark-only {list(ss - ds)[:2]} duck-only {list(ds - ss)[:2]}"
    return True, f"{len(sr)} rows"
