"""Compare Spark results with the SQL stated for them, run by DuckDB on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return f"{type(value).__name__}:{value}"

    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None if both sides agree in columns, types as Python sees them, and rows."""
    got_columns, got = _canonical(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(sql)
    want_columns, want = _canonical([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra = [row for row in got if row not in set(want)][:3]
        missing = [row for row in want if row not in set(got)][:3]
        return f"{len(got)} rows, expected {len(want)}; extra {extra}; missing {missing}"
    return None
