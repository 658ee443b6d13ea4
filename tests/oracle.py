"""Runs a query and its SQL on both engines and compares rows."""

from __future__ import annotations

import datetime
import math
import re

import duckdb

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime.combine(v, datetime.time()).isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v if v is None or isinstance(v, (str, float)) else str(v)


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def compare(spark, con, sf_dir: str, run, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    df = run(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        odd = next(((a, b) for a, b in zip(mine, theirs, strict=False) if a != b), None)
        return re.sub(r"\s+", " ", f"{len(mine)} and {len(theirs)} rows; {odd}")[:300]
    return ""
