"""Runs a registered query and its check SQL and compares every value."""

from __future__ import annotations

import duckdb

from tallymark.registry import oracle_sql, queries
from tallymark.sources.tables import SCHEMAS


def check_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, folder: str, key: str, con=None) -> str | None:
    """None when both results are equal, else a short description of the difference."""
    df = queries()[key](spark, folder)
    names = sorted(df.columns)
    ours = _sorted([tuple(r) for r in df.select(*names).collect()])
    sql = oracle_sql().get(key)
    if sql is None:
        return None if ours else "no rows"
    con = con or check_connection(folder)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    order = [rel.columns.index(n) for n in names]
    theirs = _sorted([tuple(r[i] for i in order) for r in rel.fetchall()])
    if not ours:
        return "no rows"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}; first {ours[:2]} / {theirs[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ ({names}), e.g. {bad[:2]}" if bad else None
