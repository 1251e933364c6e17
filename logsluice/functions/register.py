"""Functions for SQL users: ``infer_field_type``, ``pii_flag``, ``redact``, ``pii_spans``.

They are SQL functions, so a query that calls them is optimised as if their bodies were written out;
no Python runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from logsluice.functions.literals import sql_text
from logsluice.functions.patterns import PII_NAME_PATTERN, PII_VALUE_PATTERN, TYPE_PATTERNS
from logsluice.functions.spans import Detector, detect_sql


def register(
    spark: SparkSession, rules: Iterable[tuple[str, str]] | None = None,
    patterns: dict[str, str] | None = None,
) -> None:
    """Create the functions for this session.

    ``rules`` are the ``(pattern, label)`` pairs of ``redact``; ``patterns`` the detector patterns
    that ``pii_spans(text)`` looks for, by default those of all detectors. Its spans have offsets and
    score; a detector that needs context gives the value alone.
    """
    from logsluice.operators.detectors import DETECTORS
    from logsluice.operators.redaction import detector_rules, replacement

    types = " ".join(f"WHEN value RLIKE {sql_text(p)} THEN '{t}'" for t, p in TYPE_PATTERNS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION infer_field_type(value STRING) RETURNS STRING
        RETURN CASE {types} ELSE 'string' END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION pii_flag(name STRING, value STRING) RETURNS BOOLEAN
        RETURN name RLIKE {sql_text(PII_NAME_PATTERN)} OR coalesce(value RLIKE {sql_text(PII_VALUE_PATTERN)}, false)""")
    body = "value"
    for rule in rules or detector_rules(["EmailDetector", "IpAddressDetector", "CreditCardDetector"]):
        body = f"regexp_replace({body}, {sql_text(rule[0])}, {sql_text(replacement(rule))})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION redact(value STRING) RETURNS STRING RETURN {body}")
    wanted = [Detector(n, p) for n, p in patterns.items()] if patterns else list(DETECTORS.values())
    found = ", ".join(detect_sql("value", d, i) for i, d in enumerate(wanted))
    # An array, not a table: exploding it stays in the row, while a correlated table function is
    # planned as a join on the text.
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION pii_spans(value STRING)
        RETURNS ARRAY<STRUCT<start: INT, end: INT, ord: INT, type: STRING, text: STRING, score: DOUBLE>>
        RETURN sort_array(concat({found}))""")
