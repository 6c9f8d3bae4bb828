"""Compare a registered query with its SQL: column names, types, row count and values, whatever the row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(folder) / name}.parquet')")
    return connection


def _sortable(row):
    return tuple((v is None, str(v)) for v in row)


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def compare(df, connection, sql) -> list[str]:
    """Differences found; an empty list means that both sides agree."""
    result = connection.sql(sql)
    expected_types = dict(zip(result.columns, map(str, result.types)))
    names = sorted(df.columns)
    problems = []
    if names != sorted(expected_types):
        return [f"columns {names} != {sorted(expected_types)}"]
    for name, kind in df.dtypes:
        if TYPE_NAMES.get(kind, kind) != expected_types[name]:
            problems.append(f"type of {name}: {kind} != {expected_types[name]}")
    mine = sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=_sortable)
    order = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=_sortable)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    for a, b in zip(mine, theirs):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            for x, y in zip(a, b)
        ):
            problems.append(f"first difference {a} != {b}")
            break
    return problems
