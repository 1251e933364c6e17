"""Queries over patterns that are learned from lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.operators import templates
from logsluice.plans import oracle_text as O
from logsluice.plans.registry import query
from logsluice.sources import rendered as R
from logsluice.sources.tables import table

EV = O.EVENTS
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
SHAPES = 6


def _lines(spark, folder):
    """Six shapes of lines of one sourcetype; the first two have the same classes of tokens in the same places."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ip, login, host, kind, k = (F.col(c) for c in ("ip", "login", "host", "event_type", "k"))
    shapes = [
        R.text(iso, " INFO login of ", login, " from ", ip),
        R.text(iso, " WARN call to ", host, " via ", ip),
        R.text(iso, " WARN mail to ", F.col("email"), " bounced, ", k, " tries left."),
        R.text("user=", login, " action=", kind, " value=", F.col("val"), '; note="', kind, " by ", login, '"'),
        R.text(ip, ' [', kind, "] took ", k, " ms (", host, ")"),
        R.text('{"when": "', iso, '", "k": ', k, ', "where": {"host": "', host, '"}}')]
    which = F.col("event_id") % SHAPES
    line = F.coalesce(*[F.when(which == i, s) for i, s in enumerate(shapes)])
    # Dealt out in equal parts of a bounded size, as a file may be a single task.
    events = R.with_typed_values(table(spark, folder, "events").hint("rebalance"))
    return events.select("event_id", F.lit("app").alias("sourcetype"), line.alias("raw"))


# Per shape the names and values that its lines hold.
_FIELDS = [
    {"time": _ISO, "name": "login", "ip": "ip"},
    {"time": _ISO, "name": "host", "ip": "ip"},
    {"time": _ISO, "email": "email", "number": "k"},
    {"user": "login", "action": "event_type", "value": "val", "note": "event_type || ' by ' || login"},
    {"ip": "ip", "word": "event_type", "number": "k", "name": "host"},
    {"when": _ISO, "k": "k", "host": "host"},
]


@query("tmpl_round_trip", " UNION ALL ".join(
    f"SELECT event_id, '{n}' AS name, CAST({v} AS VARCHAR) AS value FROM ({EV}) WHERE event_id % {SHAPES} = {i}"
    for i, fields in enumerate(_FIELDS) for n, v in fields.items()))
def tmpl_round_trip(spark, folder):
    lines = _lines(spark, folder)
    read = templates.read(lines, templates.learn(lines))
    return read.select("event_id", F.explode("fields").alias("name", "value"))


@query("tmpl_patterns", " UNION ALL ".join(
    f"SELECT 'app' AS sourcetype, '{','.join(fields)}' AS names, count(*) AS lines FROM events WHERE event_id % {SHAPES} = {i}"
    for i, fields in enumerate(_FIELDS)))
def tmpl_patterns(spark, folder):
    found = templates.learn(_lines(spark, folder))
    return found.select("sourcetype", F.array_join("names", ",").alias("names"), "lines")


@query("tmpl_extract", f"""
SELECT event_id, CASE WHEN event_id % {SHAPES} IN (0, 1, 4) THEN ip END AS ip,
  CASE event_id % {SHAPES} WHEN 0 THEN login WHEN 1 THEN host WHEN 4 THEN host END AS name FROM ({EV})""")
def tmpl_extract(spark, folder):
    """The learned patterns as one expression: the first that fits reads the line."""
    lines = _lines(spark, folder)
    found = templates.extractions(templates.learn(lines))["app"]
    read = templates.extract_any(F.col("raw"), found)
    return lines.select("event_id", read["ip"].alias("ip"), read["name"].alias("name"))
