"""Run a registered query and its SQL twin and report the differences."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# DuckDB type → Spark type as printed by DataFrame.dtypes.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "BOOLEAN": "boolean",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and rows (as a multiset) agree."""
    twin = con.execute(sql)
    found = []
    names = sorted(d[0] for d in twin.description)
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} != {names}"]
    theirs = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in twin.description}
    found += [
        f"type of {name}: {kind} != {theirs[name]}" for name, kind in df.dtypes if kind != theirs[name]
    ]
    at = [[d[0] for d in twin.description].index(n) for n in names]
    expected = sorted(tuple(_plain(row[i]) for i in at) for row in twin.fetchall())
    actual = sorted(tuple(_plain(row[n]) for n in names) for row in df.collect())
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        found.append(f"{len(wrong)} rows differ, e.g. {names}\n  {wrong[0][0]}\n  {wrong[0][1]}")
    return found
