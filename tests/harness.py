"""Runs a query and its SQL twin and compares them value by value."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def _bag(columns: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want_columns, want = _bag(names, relation.fetchall())
    got_columns, got = _bag(df.columns, [tuple(r) for r in df.collect()])
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra, missing = list((got - want).elements()), list((want - got).elements())
        cut = lambda rows: [str(r)[:400] for r in sorted(rows, key=str)[:2]]
        return (
            f"{got.total()} rows, {want.total()} expected; {len(extra)} extra {cut(extra)}, "
            f"{len(missing)} missing {cut(missing)}"
        )
    if not want:
        return "both sides are empty"
    return None
