"""Compare a query with its SQL, run by an independent engine on the same tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return str(v) if v is not None else None


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in values)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if rows and columns agree, else what differs."""
    df = query(spark, sf_dir)
    names, values = duck(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, values)
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    return ""
