"""Extraction patterns compiled from typed fields.

Pattern text is built on the driver from a rule specification; lines are only touched by the
executors that apply it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logsluice.functions import patterns as P
from logsluice.functions.regexlang import _TOKEN, escape_literal, split_named_groups


@dataclass(frozen=True)
class Field:
    """A field to extract. ``regex`` may hold a group with the value."""

    name: str
    type: str = "string"
    regex: str | None = None


@dataclass(frozen=True)
class Extraction:
    """A pattern with positional groups and the name of each group, None for helper groups."""

    pattern: str
    names: tuple[str | None, ...]


def pattern_by_type(field: Field, sample: str = "") -> str:
    """The pattern of one field's value, in a group, by its type and how the sample shows it."""
    if field.type == "ip":
        return r"(\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b)"
    if field.type == "email":
        return f"({P.EMAIL_VALUE})"
    if field.type == "timestamp":
        return r"([^\s]+)"
    if field.type == "number":
        return r"(\d+)"
    if f"{field.name}=" in sample:
        return r"([^\s,]+)"
    if f'"{field.name}":' in sample:
        return r'"([^"]*)"'
    return r"([^\s]+)"


def _value(field: Field, other: str, timestamp: str | None = None) -> str:
    if field.type == "ip":
        return f"({P.IP_VALUE})"
    if field.type == "email":
        return f"({P.EMAIL_VALUE})"
    if field.type == "timestamp" and timestamp:
        return f"({timestamp})"
    return f"({other})"


def _names(fields: Sequence[Field]) -> tuple[str, ...]:
    return tuple(f.name for f in fields)


def json_pattern(fields: Sequence[Field]) -> Extraction:
    """One pattern for JSON lines whose keys occur in the given order."""
    parts = [
        rf'"{escape_literal(f.name)}"\s*:\s*"{_value(f, "[^\"]*", "[^\"]+")}"' for f in fields]
    return Extraction(r"^\{.*" + ".*".join(parts) + r".*\}$", _names(fields))


def csv_pattern(fields: Sequence[Field]) -> Extraction:
    """One pattern for comma separated lines without quoted commas."""
    parts = [_value(f, "[^,]*", "[^,]+") for f in fields]
    return Extraction("^" + r",\s*".join(parts) + "$", _names(fields))


def kv_pattern(fields: Sequence[Field], timestamp: str | None = None) -> Extraction:
    """One pattern for pairs in the given order, behind an optional timestamp."""
    parts = [f"({timestamp})"] if timestamp else []
    parts += [rf"{escape_literal(f.name)}={_value(f, r'[^\s]+')}" for f in fields]
    names = (("timestamp",) if timestamp else ()) + _names(fields)
    return Extraction("^.*" + ".*".join(parts) + ".*$", names)


def generic_pattern(fields: Sequence[Field]) -> Extraction:
    """Values in the given order, told apart by their type alone.

    Gaps are as short as possible: greedy ones cut the head off every value but the first and try
    all ways to place the values.
    """
    parts = [_value(f, r"[^\s]+") for f in fields]
    return Extraction("^.*?" + ".*?".join(parts) + ".*$", _names(fields))


def timestamp_pattern(line: DataFrame, raw: str = "raw") -> str | None:
    """The first known timestamp shape in a one-row sample."""
    tests = [F.col(raw).rlike(p).alias(f"t{i}") for i, (p, _) in enumerate(P.TIME_FORMATS_SLASH_FIRST)]
    row = line.select(*tests).first()
    for i, (pattern, _) in enumerate(P.TIME_FORMATS_SLASH_FIRST):
        if row is not None and row[i]:
            return pattern[1:-1]
    return None


def fields_in_line_order(line: DataFrame, fields: Sequence[Field], raw: str = "raw") -> list[Field]:
    """Fields by the place of their ``name=`` in a one-row sample; absent ones are left out."""
    found = [
        F.regexp_instr(raw, F.lit(rf"(?i)\b{escape_literal(f.name)}=([^\s]+)")).alias(f"p{i}")
        for i, f in enumerate(fields)]
    row = line.select(*found).first()
    placed = sorted((row[i], i) for i in range(len(fields)) if row[i])
    return [fields[i] for _, i in placed]


def _body_without_captures(pattern: str) -> str:
    """The value part of a field pattern (its first named group, if any) with captures removed."""
    tokens = list(_TOKEN.finditer(pattern))
    named = next((t for t in tokens if t["name"]), None)
    if named is not None:
        # Blank out escapes and classes so that only real parentheses count.
        bare = _TOKEN.sub(lambda t: "_" * len(t[0]) if t["skip"] is not None else t[0], pattern)
        depth, end = 1, named.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(bare[end], 0)
            end += 1
        pattern = pattern[named.end():end - 1]
    return _TOKEN.sub(
        lambda t: t[0] if t["skip"] is not None or t["special"] is not None else "(?:", pattern)


def selected_pattern(
    line: DataFrame, fields: Sequence[Field], selected: Sequence[str] = (), raw: str = "raw",
    literal_gaps: bool = False,
) -> Extraction:
    """Combine field patterns in line order; only selected fields are captured, all if none is.

    Gaps between fields match any text; ``literal_gaps`` keeps the text of the sample, which then
    fits only lines that equal it there.
    """
    bodies = {f.name: _body_without_captures(f.regex or r"\S+") for f in fields}
    whole = {f.name: split_named_groups(f.regex or r"\S+")[0] for f in fields}
    row = line.select(
        F.col(raw).alias("raw"),
        *[F.regexp_instr(raw, F.lit(whole[f.name])).alias(f"p{i}") for i, f in enumerate(fields)],
        *[F.length(F.regexp_extract(raw, whole[f.name], 0)).alias(f"l{i}") for i, f in enumerate(fields)],
    ).first()
    placed = sorted((row[f"p{i}"] - 1, row[f"l{i}"], f) for i, f in enumerate(fields) if row[f"p{i}"])
    pattern, names, last = "", [], 0
    for start, length, field in placed:
        if start > last and literal_gaps:
            pattern += escape_literal(row["raw"][last:start])
        elif pattern and not literal_gaps:
            pattern += ".*?"
        if not selected or field.name in selected:
            pattern += f"({bodies[field.name]})"
            names.append(field.name)
        else:
            pattern += f"(?:{bodies[field.name]})"
        last = max(last, start + length)
    if literal_gaps:
        pattern += escape_literal(row["raw"][last:])
    return Extraction(pattern, tuple(names))
