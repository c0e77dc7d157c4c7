"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        # The order of a sum may change the last places of a double.
        return "nan" if math.isnan(value) else f"{value:.12g}"
    if isinstance(value, Decimal):
        return f"{value.normalize():f}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    """None when equal, else a description of the first difference."""
    started = time.time()
    df = fn(spark, folder)
    mine = rows_of(df.columns, df.collect())
    spent = time.time() - started
    if sql is None:
        return (None if mine else "no rows"), spent, len(mine)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", spent, len(mine)
    if mine != theirs:
        left, right = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return f"rows {len(mine)} vs {len(theirs)}\n   cols {sorted(names)}\n   spark {left}\n   sql   {right}", spent, len(mine)
    return None, spent, len(mine)
