"""Types, personal-data flags and bands of single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from logsluice.functions.patterns import (
    CONFIDENCE_BANDS, PII_NAME_PATTERN, PII_VALUE_PATTERN, QUALITY_LABELS, TYPE_PATTERNS,
)


def _first_match(tests: list[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    chain = reduce(
        lambda acc, t: acc.when(t[0], t[1]), tests[1:], F.when(tests[0][0], tests[0][1]))
    return chain if default is None else chain.otherwise(default)


def infer_field_type(value: Column) -> Column:
    """timestamp, ip, email, integer, float or string; the order decides."""
    return _first_match([(value.rlike(p), F.lit(t)) for t, p in TYPE_PATTERNS], F.lit("string"))


def infer_json_type(value: Column) -> Column:
    """Like :func:`infer_field_type` for a VARIANT, whose own kind comes first."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BOOLEAN", "boolean")
        .when(kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number")
        .otherwise(infer_field_type(F.try_variant_get(value, "$", "string")))
    )


def pii_flag(name: Column, value: Column) -> Column:
    """True if the field name or the whole value looks like personal data."""
    return name.rlike(PII_NAME_PATTERN) | F.coalesce(value.rlike(PII_VALUE_PATTERN), F.lit(False))


def confidence_band(confidence: Column) -> Column:
    """Band of a confidence; N/A for null or NaN."""
    bands = [(confidence >= limit, F.lit(label)) for limit, label in CONFIDENCE_BANDS]
    missing = confidence.isNull() | F.isnan(confidence)
    return _first_match([(missing, F.lit("N/A")), *bands], F.lit("error"))


def quality_label(percent: Column) -> Column:
    return _first_match([(percent >= low, F.lit(label)) for low, label in QUALITY_LABELS], None)


def typed_value(value: Column, type_name: str) -> Column:
    """Cast an extracted text to the physical type of its inferred type; NULL if it does not fit."""
    physical = {
        "number": "double", "float": "double", "integer": "bigint", "boolean": "boolean",
        "timestamp": "timestamp", "datetime": "timestamp",
    }.get(type_name)
    return value.try_cast(physical) if physical else value
