"""Compare a query with its SQL on the same parquet tables."""

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return "null" if value is None else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kinds(types):
    """Type names of both engines on one scale."""
    same = {
        "bigint": "long", "long": "long", "integer": "int", "int": "int", "varchar": "string",
        "string": "string", "boolean": "bool", "double": "double",
    }
    return [same.get(t.lower(), t.lower()) for t in types]


def difference(df, con, sql):
    """Empty text when equal, else what differs."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want_types = dict(zip(names, kinds([str(c[1]) for c in cursor.description])))
    want = rows_of(names, cursor.fetchall())
    got_types = dict(zip(df.columns, kinds([t for _, t in df.dtypes])))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_types != want_types:
        return f"types: {sorted(set(got_types.items()) ^ set(want_types.items()))}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    if got != want:
        first = next((g, w) for g, w in zip(got, want) if g != w)
        cells = [(g[:300], w[:300]) for g, w in zip(*first) if g != w]
        bad = len(set(got) ^ set(want))
        return f"columns {sorted(names)}; {bad} odd rows; first difference: {cells}"
    return ""
