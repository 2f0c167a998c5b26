"""A query's rows and its SQL's rows, compared as bags."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.sql(sql)
    a, b = bag(df.columns, df.collect()), bag(found.columns, found.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"{sum(a[1].values())} and {sum(b[1].values())} rows; ours only {list((a[1] - b[1]).items())[:3]}; SQL only {list((b[1] - a[1]).items())[:3]}"
    return ""
