"""Compare a query with its SQL as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def norm(v, digits=9):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (float(f"{v:.{digits}g}") + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x, digits)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple(norm(x, digits) for x in v)
    return v


def diff(spark_df, con, sql: str) -> str:
    """Empty if both agree; else what differs."""
    a_cols = spark_df.columns
    a = spark_df.collect()
    rel = con.execute(sql)
    b_cols = [d[0] for d in rel.description]
    b = rel.fetchall()
    if sorted(a_cols) != sorted(b_cols):
        return f"columns {sorted(a_cols)} against {sorted(b_cols)}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    order_a, order_b = [a_cols.index(c) for c in sorted(a_cols)], [b_cols.index(c) for c in sorted(b_cols)]
    key = lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", x if not isinstance(x, tuple) else str(x)) for x in r)
    x = sorted((tuple(norm(r[i]) for i in order_a) for r in a), key=key)
    y = sorted((tuple(norm(r[i]) for i in order_b) for r in b), key=key)
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} of {len(x)} rows differ ({sorted(a_cols)}): {bad[:2]}" if bad else ""
