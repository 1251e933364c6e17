"""Constant arrays and maps as columns.

They are written as SQL text: one expression for the whole table instead of a column per entry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def sql_text(text: str) -> str:
    """A SQL string literal. Backslashes are part of the text."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def text_array(values: Sequence[str]) -> Column:
    return F.expr(f"array({', '.join(map(sql_text, values))})")


def struct_array(rows: Sequence[Sequence[str | int]], names: Sequence[str]) -> Column:
    """``array<struct<…>>`` with a struct per row."""
    def value(v: str | int) -> str:
        return sql_text(v) if isinstance(v, str) else str(v)

    structs = [
        "named_struct(" + ", ".join(f"{sql_text(n)}, {value(v)}" for n, v in zip(names, row)) + ")"
        for row in rows]
    return F.expr(f"array({', '.join(structs)})")


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """The value under a key, NULL for other keys."""
    entries = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)
