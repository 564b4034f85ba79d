"""Compare a Spark result with the SQL result over the same tables, cell by cell."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame, connection, sql: str) -> list[str]:
    """Readable differences; empty when both results hold the same rows."""
    wanted = connection.execute(sql)
    wanted_names = [column[0] for column in wanted.description]
    if sorted(frame.columns) != sorted(wanted_names):
        return [f"columns: {sorted(frame.columns)} / {sorted(wanted_names)}"]
    kinds = {column[0]: str(column[1]) for column in wanted.description}
    got_kinds = dict(frame.dtypes)
    pairs = {"bigint": {"BIGINT"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"}, "int": {"INTEGER"}}
    odd = [
        f"type of {name}: {kind} / {kinds[name]}"
        for name, kind in got_kinds.items()
        if kinds[name] not in pairs.get(kind, set())
    ]
    got, expected = _rows(frame.columns, frame.collect()), _rows(wanted_names, wanted.fetchall())
    if got == expected:
        return odd
    return odd + [
        f"rows: {sum(got.values())} / {sum(expected.values())}",
        f"only here: {list((got - expected).items())[:2]}",
        f"only in SQL: {list((expected - got).items())[:2]}",
    ]
