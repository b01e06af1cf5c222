"""Compares a query's rows with its SQL's, as sets of rows with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connected(folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(frame, sql: str, folder: str) -> str:
    """Empty if all is equal."""
    con = connected(folder).execute(sql)
    names = [c[0] for c in con.description]
    want, got = rows_of(names, con.fetchall()), rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} for {sorted(names)}"
    missing, extra = want - got, got - want
    return "" if not missing and not extra else f"{sum(got.values())} rows for {sum(want.values())}; missing {list(missing)[:2]}; extra {list(extra)[:2]}"
