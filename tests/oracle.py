"""Compare a registered query with its SQL: rows, column names and types, values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "double",
    "double": "double", "string": "str", "boolean": "bool", "timestamp": "time",
    "timestamp_ntz": "time", "date": "date",
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "FLOAT": "double",
    "DOUBLE": "double", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _canon(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, list):
        return tuple(_canon(v) for v in value)
    return value


def _rows(rows, order):
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, sql: str, con) -> list[str]:
    """Empty if both sides agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    expected = cursor.fetchall()
    found = spark_df.collect()
    out = []
    left = {n: _KINDS.get(t, t) for n, t in spark_df.dtypes}
    right = {n: _KINDS.get(t, t) for n, t in zip(names, types)}
    if left != right:
        out.append(f"schema {left} != {right}")
    if sorted(left) != sorted(right):
        return out
    cols = sorted(left)
    a = _rows(found, [spark_df.columns.index(c) for c in cols])
    b = _rows(expected, [names.index(c) for c in cols])
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [r for r in a if r not in in_b][:3]
        only_b = [r for r in b if r not in in_a][:3]
        out.append(f"values over {cols}:\n  spark {only_a}\n  sql   {only_b}")
    return out
