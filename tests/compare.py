"""Run a query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _shown(x) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return format(round(x, 6) + 0.0, ".9g")
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_shown, x)) + "]"
    return str(x)


def duck(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_shown(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, folder: str) -> None:
    columns, want = duck(sql, folder)
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, want)
