"""Compares a query's rows with its check SQL, value by value."""

from __future__ import annotations

import os

import duckdb

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def _order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def check_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def differences(spark, folder: str, query, sql: str | None) -> str | None:
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = _order([tuple(r) for r in df.select(*names).collect()])
    if sql is None:
        return f"{len(ours)} rows, no SQL"
    got = check_connection(folder).sql(sql)
    if sorted(got.columns) != names:
        return f"columns {names} against {sorted(got.columns)}"
    at = [got.columns.index(n) for n in names]
    theirs = _order([tuple(r[i] for i in at) for r in got.fetchall()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ ({names}): {str(bad[:2])[:1500]}" if bad else None
