"""Compares a Spark result with DuckDB's result of the same query."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_plain(row[i]) for i in order) for row in data]
    return [columns[i] for i in order], sorted(picked, key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Raises if the two differ in columns, rows or any value; returns the row count."""
    relation = con.sql(sql)
    want_columns, want = rows(relation.columns, relation.fetchall())
    got_columns, got = rows(df.columns, [tuple(row) for row in df.collect()])
    assert got_columns == want_columns, (got_columns, want_columns)
    if got != want:
        only_got = sorted(set(got) - set(want), key=repr)
        only_want = sorted(set(want) - set(got), key=repr)
        raise AssertionError(
            f"{len(got)} rows, expected {len(want)}; "
            f"only Spark ({len(only_got)}): {only_got[:3]}; "
            f"only SQL ({len(only_want)}): {only_want[:3]}; columns {got_columns}"
        )
    return len(got)
