"""Compare a Spark result with the DuckDB result of its SQL, value by value."""

from __future__ import annotations

import datetime
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark and DuckDB names of the same type
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def difference(connection, sql: str, result) -> str | None:
    """None where both hold the same rows, else what differs."""
    expected = connection.sql(sql)
    names = sorted(result.columns)
    if names != sorted(expected.columns):
        return f"columns {names} against {sorted(expected.columns)}"
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    for field in result.schema.fields:
        if SAME_TYPE.get(field.dataType.simpleString()) != kinds[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} against {kinds[field.name]}"
    order = [expected.columns.index(n) for n in names]
    wanted = Counter(tuple(plain(row[i]) for i in order) for row in expected.fetchall())
    found = Counter(tuple(plain(row[n]) for n in names) for row in result.collect())
    if wanted == found:
        return None
    missing, extra = wanted - found, found - wanted
    return (
        f"{sum(missing.values())} rows missing, {sum(extra.values())} extra, of {sum(wanted.values())}; "
        f"missing {list(missing)[:2]}, extra {list(extra)[:2]}"
    )
