"""Compares registered queries with DuckDB on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF_ROOT = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    return value


def _sorted(rows, order):
    picked = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(picked, key=repr)


# Spark types and the DuckDB types that count as equal.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in columns, types or rows; empty when both agree exactly."""
    cursor = connection.execute(sql)
    expected_types = {d[0]: str(d[1]) for d in cursor.description}
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    actual = [tuple(row) for row in df.collect()]
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind) != expected_types[name]:
            problems.append(f"{name}: {kind} vs {expected_types[name]}")
    order = sorted(names)
    left = _sorted(actual, [df.columns.index(n) for n in order])
    right = _sorted(expected, [names.index(n) for n in order])
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)}")
    elif left != right:
        first = next(i for i, pair in enumerate(zip(left, right)) if pair[0] != pair[1])
        problems.append(f"row {first}: {left[first]} != {right[first]}")
    return problems
