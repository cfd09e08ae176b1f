"""Comparison of a query's rows with its SQL in DuckDB: as bags, values by type."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows)


def compare(df, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    mine, theirs = bag(df.collect(), df.columns), bag(out.fetchall(), names)
    if not theirs:
        return "the SQL gives no rows"
    if mine == theirs:
        return None
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark: {list((mine - theirs).items())[:2]}; only SQL: {list((theirs - mine).items())[:2]}"
