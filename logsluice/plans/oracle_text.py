"""Building blocks of the SQL that checks the queries (RE2 regular expressions, list functions)."""

from __future__ import annotations

from collections.abc import Sequence

from logsluice.functions import patterns as P
from logsluice.operators.detectors import CANONICAL_TYPES, DETECTORS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values: Sequence[str]) -> str:
    return ", ".join(lit(v) for v in values)


def digits(number: str, width: int) -> str:
    return f"lpad(CAST({number} % {10**width} AS VARCHAR), {width}, '0')"


def escaped(column: str) -> str:
    return rf"regexp_replace({column}, '([\\.^$|?*+()\[\]{{}}\-])', '\\\1', 'g')"


def _one_detector(
    relation: str, keys: Sequence[str], text: str, name: str, pattern: str, in_context: bool, order: int,
) -> str:
    names = [k.split(" AS ")[-1] for k in keys]
    p = lit(pattern)
    value = f"regexp_extract_all({text}, {p}, {2 if in_context else 0})"
    lead = f"regexp_extract_all({text}, {p}, 1)" if in_context else "NULL::VARCHAR[]"
    lead_length = "coalesce(length(lead[i]), 0)"
    before = (
        "list_sum(list_transform(gaps[1:i], lambda s: length(s))) + "
        "coalesce(list_sum(list_transform(whole[1:i-1], lambda s: length(s))), 0)")
    return f"""
SELECT {', '.join(names)}, CAST(pos AS BIGINT) AS start_pos, CAST(pos + length(text) AS BIGINT) AS end_pos,
  {order} AS ord, {lit(name)} AS type, text
FROM (
  SELECT {', '.join(names)}, val[i] AS text, {before} + {lead_length} AS pos
  FROM (
    SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
      SELECT {', '.join(keys)}, regexp_extract_all({text}, {p}) AS whole, {value} AS val,
        {lead} AS lead, string_split_regex({text}, {p}) AS gaps
      FROM {relation})))
WHERE length(trim(text)) >= {3}"""


def spans(relation: str, keys: Sequence[str], text: str, detectors: Sequence[str]) -> str:
    """Spans of detectors with offsets."""
    return " UNION ALL ".join(
        _one_detector(relation, keys, text, n, DETECTORS[n].pattern, DETECTORS[n].in_context, i)
        for i, n in enumerate(detectors))


def custom_spans(
    relation: str, keys: Sequence[str], text: str, patterns: Sequence[tuple[str, str]], first: int = 0,
) -> str:
    return " UNION ALL ".join(
        _one_detector(relation, keys, text, n, p, False, first + i) for i, (n, p) in enumerate(patterns))


def canonical(spans_sql: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in CANONICAL_TYPES.items())
    return f"SELECT *, CASE type {cases} ELSE upper(type) END AS canonical FROM ({spans_sql})"


def infer_field(spans_sql: str, text: str) -> str:
    context = (
        f"substr({text}, greatest(start_pos - 50, 0) + 1, end_pos + 50 - greatest(start_pos - 50, 0))")
    return f"""
SELECT *, coalesce(
  nullif(regexp_extract(ctx, {lit(P.KV_KEY)}, 1), ''), nullif(regexp_extract(ctx, {lit(P.JSON_KEY)}, 1), ''),
  CASE WHEN regexp_matches({text}, {lit(P.LEADING_IP)}) THEN CASE WHEN start_pos < 20 THEN 'clientip'
    WHEN contains(ctx, '[') AND contains(ctx, ']') THEN 'timestamp' WHEN contains(ctx, '"') THEN 'request' END END,
  lower(type)) AS field
FROM (SELECT *, {context} AS ctx FROM ({spans_sql}))"""


# Lines rendered by the same rule as in sources/rendered.py, where offsets are compared.
CONTACTS = f"""
SELECT c_custkey, c_mktsegment, email, ip, phone, ssn, card, CASE c_custkey % 3
  WHEN 0 THEN 'mail='||email||' addr='||ip||' tel='||phone||' seg='||c_mktsegment
  WHEN 1 THEN '{{"ssn":"'||ssn||'","card":"'||card||'","seg":"'||c_mktsegment||'"}}'
  ELSE ip||' - - [01/Jan/2024:12:00:00 +0000] "GET /?m=x HTTP/1.1" 200 12 '||email END AS raw
FROM (SELECT c_custkey, c_mktsegment, 'c'||c_custkey||'@shop.example.org' AS email,
  '192.168.'||(c_custkey%256)||'.'||(c_custkey%250) AS ip,
  '555-'||{digits('c_custkey', 3)}||'-'||{digits('(c_custkey*7)', 4)} AS phone,
  {digits('c_custkey', 3)}||'-'||{digits('c_custkey', 2)}||'-'||{digits('(c_custkey*3)', 4)} AS ssn,
  '4111-1111-'||{digits('c_custkey', 4)}||'-'||{digits('(c_custkey*11)', 4)} AS card FROM customer)"""

EVENTS = """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  '10.'||(user_id//256)||'.'||(user_id%256)||'.'||(event_id%250) AS ip, 'user'||user_id AS login,
  'user'||user_id||'@mail.example.com' AS email, 'host'||(user_id%10) AS host,
  printf('%.2f', value) AS val,
  ['apache', 'json', 'csv', 'kv', 'syslog', 'xml'][event_id % 6 + 1] AS sourcetype,
  event_type AS index_name
FROM events"""
