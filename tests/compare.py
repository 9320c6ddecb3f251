"""Comparison of a Spark result with a DuckDB result, regardless of row order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(type_name):
    name = type_name.lower()
    for kind, marks in {
        "float": ("double", "float", "real", "decimal"),
        "bool": ("bool",),
        "list": ("array", "[]"),
        "int": ("int", "long"),
        "text": ("string", "varchar"),
        "time": ("timestamp", "date"),
    }.items():
        if any(m in name for m in marks):
            return kind
    return name


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return repr(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def mismatch(df, con, sql):
    """None if equal, else a text that says what differs."""
    result = con.execute(sql)
    described = [(d[0], str(d[1])) for d in result.description]
    expected = result.fetchall()
    kinds = {n: _kind(t) for n, t in described}
    ours = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    if ours != kinds:
        return f"schema: spark {ours} sql {kinds}"
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(expected):
        return f"rows: spark {len(got)} sql {len(expected)}"
    a = _bag(df.columns, got)
    b = _bag([n for n, _ in described], expected)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"values: {len(sa - sb)} only in spark {sorted(sa - sb)[:2]}, sql {sorted(sb - sa)[:2]}"
