"""Comparison of a query with its SQL."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def views(folder: str = DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{folder}/{name}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in values)


def check(df, sql: str, con) -> int:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(names, found.fetchall())
    return len(got)
