"""Comparison of a query with its SQL, the way the driver does it: rows as a multiset, columns by name."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), Counter(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in cur.fetchall())


def spark_rows(df):
    names = df.columns
    return sorted(names), Counter(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in df.collect())


def differences(df, sql: str, sf_dir: str) -> str:
    a, b = spark_rows(df), oracle_rows(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] == b[1]:
        return ""
    return f"{sum(a[1].values())} and {sum(b[1].values())} rows; only here {list((a[1] - b[1]).items())[:3]}; only there {list((b[1] - a[1]).items())[:3]}"
