"""Comparison of a query with DuckDB on the same tables."""

import decimal
import os

import duckdb


def norm(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


def rows(df):
    return sorted((tuple(map(norm, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)


def duck(sql, sf=None, tables=None):
    con = duckdb.connect()
    for name, frame in (tables or {}).items():
        con.register(name, frame)
    for f in os.listdir(sf) if sf else []:
        con.execute(f"create view {f.partition('.')[0]} as select * from read_parquet('{sf}/{f}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=repr)


def same(df, sql, sf=None, tables=None):
    names, expected = duck(sql, sf, tables)
    assert sorted(df.columns) == names
    assert rows(df) == expected
