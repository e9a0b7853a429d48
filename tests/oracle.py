"""Holds a query's rows against those of its SQL."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ in ("Decimal", "int64", "float64"):
        x = float(value)
        return None if math.isnan(x) else float(f"{x:.9g}")
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, query, sql, folder):
    frame = query(spark, folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    got, want = rows(frame.columns, frame.collect()), rows(names, result.fetchall())
    assert len(got) == len(want)
    assert got == want
