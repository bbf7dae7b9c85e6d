"""Compares queries with their SQL."""

import math

import duckdb

from lexmill.plans.inputs import TABLES


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return repr(v) if not hasattr(v, "as_tuple") else repr(float(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    got = run(spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b), f"{len(a)} rows, {len(b)} from SQL; first other ones {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
