"""Run a registered query on Spark and its SQL on DuckDB and compare all values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(folder) / (t + '.parquet')}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r]
    )


def compare(spark, con, folder, fn, sql):
    got = fn(spark, folder)
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    return have, want
