"""Queries over types, times and the field catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.functions import extract as X
from logsluice.functions import patterns as P
from logsluice.functions import timeparse as T
from logsluice.functions import typing as Y
from logsluice.functions.rows import each
from logsluice.operators import fields, sketches
from logsluice.plans import oracle_text as O
from logsluice.plans.registry import query
from logsluice.sources import rendered as R
from logsluice.sources.tables import table

EV = O.EVENTS
CSV_HEADER = ["id", "stamp", "kind", "note", "val", "empty"]
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"

# What the rendered lines of each format contain, in line order.
TYPED_FIELDS = {
    "apache": {"clientip": "ip", "ident": "'-'", "auth": "login",
               "timestamp": "strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000'",
               "request": "'GET /'||event_type||'/'||k||' HTTP/1.1'",
               "status": "CASE event_type WHEN 'error' THEN '500' ELSE '200' END",
               "bytes": "user_id*10+k", "method": "'GET'", "uri": "'/'||event_type||'/'||k",
               "protocol": "'HTTP/1.1'"},
    "json": {"timestamp": f"{_ISO}||'Z'", "event": "event_type", "user_id": "user_id",
             "ok": "CASE event_type WHEN 'error' THEN 'false' ELSE 'true' END", "src": "ip", "email": "email",
             "ctx": "'{\"host\":\"'||host||'\",\"k\":'||k||'}'", "tags": "'[\"'||event_type||'\",\"t'||(k%3)||'\"]'"},
    "csv": {"id": "event_id", "stamp": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "kind": "event_type",
            "note": "'said \"'||login||'\", then left'", "val": "val", "empty": "''"},
    "kv": {"ts": _ISO, "user": "login", "email": "email", "client_ip": "ip", "event": "event_type", "value": "val"},
    "syslog": {"timestamp": "strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S')",
               "host": "host",
               "message": "'event='||event_type||' user='||login||' value: '||val||' code = '||k",
               "event": "event_type", "user": "login", "value": "val", "code": "k"},
    "xml": {"id": "event_id", "type": "event_type", "user": "login"},
}


def typed_records(extra: str = "") -> str:
    """``(event_id, sourcetype, pos, name, value, …)`` of all rendered events from typed columns."""
    return " UNION ALL ".join(
        f"SELECT event_id, sourcetype, {i} AS pos, '{n}' AS name, CAST({v} AS VARCHAR) AS value{extra} "
        f"FROM ({EV}) WHERE sourcetype = '{s}'"
        for s, names in TYPED_FIELDS.items() for i, (n, v) in enumerate(names.items()))


def parsed_events(spark, folder):
    """Rendered events with their detected format and field pairs."""
    return fields.extract_auto(rendered(spark, folder), header=CSV_HEADER)


def rendered(spark, folder):
    return R.rendered_events(spark, folder)


def records(spark, folder, keys=("event_id", "sourcetype")):
    return fields.field_records(
        parsed_events(spark, folder), list(keys),
        confidence=fields.format_confidence(F.col("fmt")))


_TYPE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(value, {O.lit(p)}) THEN '{t}'" for t, p in P.TYPE_PATTERNS) + " ELSE 'string' END"
_FLAG = f"(regexp_matches(name, {O.lit(P.PII_NAME_PATTERN)}) OR regexp_matches(value, {O.lit(P.PII_VALUE_PATTERN)}))"


@query("ext_auto", f"""
SELECT event_id, sourcetype, pos, name, value, {_TYPE_CASE} AS type, {_FLAG} AS is_pii,
  CASE sourcetype WHEN 'json' THEN 0.95 WHEN 'apache' THEN 0.95 WHEN 'csv' THEN 0.9 WHEN 'syslog' THEN 0.85
    ELSE 0.8 END::DOUBLE AS confidence FROM ({typed_records()})""")
def ext_auto(spark, folder):
    """Format detection, extraction, typing and flags over lines of six formats."""
    return records(spark, folder).select(
        "event_id", "sourcetype", "pos", "name", "value", "type", "is_pii", "confidence")


@query("type_infer", f"""
SELECT {_TYPE_CASE} AS type, count(*) AS items, count(DISTINCT value) AS values
FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY 1""")
def type_infer(spark, folder):
    # Words repeat, so they are counted before their type is looked at.
    words = each(table(spark, folder, "documents"), [], F.split("text", " "), "value")
    counted = words.groupBy("value").agg(F.count("*").alias("n"))
    return counted.groupBy(Y.infer_field_type(F.col("value")).alias("type")).agg(
        F.sum("n").alias("items"), F.count("*").alias("values"))


@query("type_cast", """
SELECT event_id, user_id, value, date_trunc('second', ts) AS stamp, NULL::BIGINT AS bad FROM events""")
def type_cast(spark, folder):
    events = R.typed_events(spark, folder)
    as_text = events.select(
        "event_id", F.col("user_id").cast("string").alias("u"), F.col("val"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("login"))
    return as_text.select(
        "event_id", Y.typed_value(F.col("u"), "integer").alias("user_id"),
        Y.typed_value(F.col("val"), "float").alias("value"),
        Y.typed_value(F.col("t"), "timestamp").cast("timestamp_ntz").alias("stamp"),
        Y.typed_value(F.col("login"), "integer").alias("bad"))


@query("type_profile", f"""
WITH c AS (SELECT sourcetype, name, {_TYPE_CASE} AS type, count(*) AS n FROM ({typed_records()}) GROUP BY ALL)
SELECT sourcetype, name, CAST(sum(n) AS BIGINT) AS items, count(*) AS types,
  CASE WHEN count(*) = 1 THEN min(type) WHEN bool_and(type IN ('integer', 'float')) THEN 'float' ELSE 'string' END AS type,
  round(max(n) / sum(n), 4) AS top_share FROM c GROUP BY sourcetype, name""")
def type_profile(spark, folder):
    return fields.type_profile(records(spark, folder))


_PII_NAMES = ["user_name", "account", "hotel", "note", "pwd", "Social Security", "seg"]


@query("pii_flag_fields", f"""
WITH c AS (SELECT c_custkey, {O.lit('|'.join(_PII_NAMES))} AS n, ssn, phone, card, email FROM ({O.CONTACTS})),
v AS (SELECT c_custkey, string_split(n, '|')[c_custkey % 7 + 1] AS name,
  CASE c_custkey % 5 WHEN 0 THEN ssn WHEN 1 THEN phone WHEN 2 THEN card WHEN 3 THEN email ELSE 'plain' END AS value FROM c)
SELECT c_custkey, name, {_FLAG} AS is_pii FROM v""")
def pii_flag_fields(spark, folder):
    key = F.col("c_custkey")
    name = F.get(F.array(*map(F.lit, _PII_NAMES)), (key % 7).cast("int"))
    turn = key % 5
    value = F.when(turn == 0, F.col("ssn")).when(turn == 1, F.col("phone")).when(
        turn == 2, F.col("card")).when(turn == 3, F.col("email")).otherwise("plain")
    return R.customer_contacts(spark, folder).select(
        "c_custkey", name.alias("name"), Y.pii_flag(name, value).alias("is_pii"))


@query("conf_band", """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 500000 END AS c FROM orders)
SELECT CASE WHEN c IS NULL THEN 'N/A' WHEN c >= 0.9 THEN 'success' WHEN c >= 0.7 THEN 'info'
  WHEN c >= 0.5 THEN 'warning' ELSE 'error' END AS band, count(*) AS items FROM c GROUP BY 1""")
def conf_band(spark, folder):
    confidence = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000)
    return table(spark, folder, "orders").groupBy(Y.confidence_band(confidence).alias("band")).agg(
        F.count("*").alias("items"))


# --- Time ---------------------------------------------------------------------------------------

@query("time_format_a", f"""
SELECT event_id, CASE sourcetype WHEN 'apache' THEN '%d/%b/%Y:%H:%M:%S' WHEN 'csv' THEN '%Y-%m-%d %H:%M:%S'
  WHEN 'syslog' THEN CASE WHEN day(ts) >= 10 THEN '%b %d %H:%M:%S' ELSE 'CURRENT_TIME' END
  WHEN 'xml' THEN 'CURRENT_TIME' ELSE '%Y-%m-%dT%H:%M:%S' END AS time_format FROM ({EV})""")
def time_format_a(spark, folder):
    return rendered(spark, folder).select("event_id", T.detect_time_format(F.col("raw")).alias("time_format"))


@query("time_format_b", f"""
SELECT event_id, CASE sourcetype WHEN 'apache' THEN '%d/%b/%Y:%H:%M:%S' WHEN 'csv' THEN '%Y-%m-%d %H:%M:%S'
  WHEN 'syslog' THEN '%b %d %H:%M:%S' WHEN 'xml' THEN 'CURRENT_TIME' ELSE '%Y-%m-%dT%H:%M:%S' END AS time_format
FROM ({EV})""")
def time_format_b(spark, folder):
    return rendered(spark, folder).select(
        "event_id", T.detect_time_format(F.col("raw"), slash_first=True).alias("time_format"))


@query("time_parse", f"SELECT event_id, date_trunc('second', ts) AS event_time FROM ({EV})")
def time_parse(spark, folder):
    raw, ingest = F.col("raw"), F.date_trunc("second", "ts")
    settings = {
        "apache": ("%d/%b/%Y:%H:%M:%S %z", r"\[", 29), "json": ("%Y-%m-%dT%H:%M:%S", '"timestamp":"', 25),
        "csv": ("%Y-%m-%d %H:%M:%S", r"^\d+,", 25), "kv": ("%Y-%m-%dT%H:%M:%S", "ts=", 25),
        "syslog": ("%b %d %H:%M:%S", "^", 15), "xml": ("CURRENT_TIME", "", 25)}
    chain = None
    for kind, (fmt, prefix, lookahead) in settings.items():
        when = F.when if chain is None else chain.when
        chain = when(F.col("sourcetype") == kind, T.parse_time(raw, fmt, prefix, lookahead, ingest))
    return rendered(spark, folder).select("event_id", chain.cast("timestamp_ntz").alias("event_time"))


@query("time_formats_all", """
SELECT o_orderkey, o_orderdate + to_seconds(o_custkey % 86400) AS t0, t0 AS t1, t0 AS t2, t0 AS t3, t0 AS t4 FROM orders""")
def time_formats_all(spark, folder):
    """The formats that no rendered line uses."""
    stamp = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 86400)
    formats = {
        "%m/%d/%Y %H:%M:%S": "MM/dd/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S": "dd/MM/yyyy HH:mm:ss",
        "%d-%m-%Y %H:%M:%S": "dd-MM-yyyy HH:mm:ss", "%Y%m%d %H:%M:%S": "yyyyMMdd HH:mm:ss",
        "%d/%b/%Y:%H:%M:%S": "dd/MMM/yyyy:HH:mm:ss"}
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", *[
        T.parse_time(R.text("at ", F.date_format(stamp, java), " x"), fmt, "^at ", 25).cast(
            "timestamp_ntz").alias(f"t{i}")
        for i, (fmt, java) in enumerate(formats.items())])


@query("time_syslog_year", f"""
SELECT event_id, TIMESTAMP '2024-01-01' + to_hours(k - 50) AS event_time FROM ({EV})""")
def time_syslog_year(spark, folder):
    """Times around New Year without a year, read five minutes later."""
    stamp = F.timestamp_seconds(F.lit(1704067200) + (F.col("k") - 50) * 3600)
    lines = R.typed_events(spark, folder).select(
        "event_id", F.date_format(stamp, "MMM d HH:mm:ss").alias("raw"),
        (stamp + F.expr("INTERVAL 5 MINUTES")).alias("ingest"))
    return lines.select("event_id", T.parse_time(
        F.col("raw"), "%b %d %H:%M:%S", ingest_time=F.col("ingest")).cast("timestamp_ntz").alias("event_time"))


@query("time_json_prefix", f"""
SELECT event_id, CASE k % 3 WHEN 0 THEN '"timestamp":"' WHEN 1 THEN '"time":"' ELSE '' END AS prefix FROM ({EV})""")
def time_json_prefix(spark, folder):
    key = F.when(F.col("k") % 3 == 0, "timestamp").when(F.col("k") % 3 == 1, "time").otherwise("when")
    line = R.text('{"', key, '":"', F.date_format("ts", "yyyy"), '"}')
    return R.typed_events(spark, folder).select("event_id", T.json_time_prefix(line).alias("prefix"))


# --- Sets of records ----------------------------------------------------------------------------

_SOURCE = "CASE WHEN name IN ('timestamp', 'host') THEN 'existing' ELSE 'auto_detect' END"


def _tagged(spark, folder):
    return records(spark, folder).withColumn("source", F.when(
        F.col("name").isin("timestamp", "host"), fields.EXISTING).otherwise(F.col("source")))


@query("fields_new_only", f"""
SELECT event_id, name, value FROM ({typed_records()}) WHERE {_SOURCE} <> 'existing'""")
def fields_new_only(spark, folder):
    return fields.new_only(_tagged(spark, folder)).select("event_id", "name", "value")


@query("fields_anti", f"""
SELECT DISTINCT sourcetype, name FROM ({typed_records()}) r
WHERE name NOT IN ('user', 'email', 'timestamp', 'event')""")
def fields_anti(spark, folder):
    found = records(spark, folder).select("sourcetype", "name").distinct()
    generic = records(spark, folder).filter(
        F.col("name").isin("user", "email", "timestamp", "event")).select("name")
    return fields.absent_by_name(found, generic, ["name"]).select("sourcetype", "name")


@query("fields_upsert", f"""
SELECT event_id, name, value, 'auto_detect' AS source FROM ({typed_records()}) WHERE sourcetype = 'kv'
UNION ALL SELECT event_id, 'who', login, 'custom_regex' FROM ({EV}) WHERE sourcetype = 'kv'""")
def fields_upsert(spark, folder):
    """Two rounds of a custom pattern: the second replaces the first and leaves the rest."""
    kv = rendered(spark, folder).filter(F.col("sourcetype") == "kv")
    auto = fields.field_records(kv.select("event_id", X.kv_pairs(F.col("raw")).alias("pairs")), ["event_id"])

    def custom(pattern):
        found = kv.select("event_id", X.named_group_pairs(F.col("raw"), pattern).alias("pairs"))
        return fields.field_records(found, ["event_id"], source=fields.CUSTOM, confidence=0.9, from_regex=True)

    catalogue = auto.unionByName(custom(r"event=(?P<what>\w+)"))
    return fields.upsert_source(catalogue, custom(r"user=(?P<who>\w+)"), fields.CUSTOM).select(
        "event_id", "name", "value", "source")


_ORDERED = ["value", "event", "user", "absent"]


@query("fields_ordered", f"""
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'user,event,value' ELSE 'value,user,event' END AS names FROM ({EV})""")
def fields_ordered(spark, folder):
    a, b, c = (R.text(f"{n}=", F.col(col)) for n, col in (("user", "login"), ("event", "event_type"), ("value", "val")))
    line = F.when(F.col("k") % 2 == 0, F.concat_ws(" ", a, b, c)).otherwise(F.concat_ws(" ", c, a, b))
    return R.typed_events(spark, folder).select(
        "event_id", F.array_join(fields.ordered_fields(line, _ORDERED), ",").alias("names"))


@query("values_longest", f"""
SELECT DISTINCT name, value FROM ({typed_records()}) WHERE value <> 'N/A' AND length(value) > 2
ORDER BY length(value) DESC, value, name""")
def values_longest(spark, folder):
    return fields.longest_values(records(spark, folder)).select("name", "value")


# --- Profiles -----------------------------------------------------------------------------------

@query("field_profile", f"""
WITH r AS ({typed_records()}), v AS (SELECT sourcetype, name, value, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT sourcetype, count(*) AS lines FROM ({EV}) GROUP BY 1)
SELECT v.sourcetype, name, CAST(sum(n) AS BIGINT) AS items, CAST(sum(n) AS BIGINT) AS events,
  count(*) AS distinct_values, min(length(value)) AS min_length, max(length(value)) AS max_length,
  arg_min(value, (-n, value)) AS top_value, any_value(lines) AS lines, round(sum(n) / any_value(lines), 4) AS fill_rate
FROM v JOIN t USING (sourcetype) GROUP BY v.sourcetype, name""")
def field_profile(spark, folder):
    parsed = parsed_events(spark, folder)
    marked = each(parsed, ["sourcetype"], fields.mark_first_in_event(F.col("pairs"))).select(
        "sourcetype", "s.name", "s.value", F.col("s.first").alias("first_in_event"))
    return fields.profile(marked, rendered(spark, folder))


@query("field_drift", f"""
WITH f AS (SELECT sourcetype, name, min(ts) AS first_ts FROM (
    SELECT index_name AS sourcetype, ts, unnest(['k'||k, 'login']) AS name FROM ({EV})) GROUP BY ALL),
h AS (SELECT sourcetype, date_trunc('hour', first_ts) AS hour, count(*) AS new_fields FROM f GROUP BY ALL)
SELECT sourcetype, hour, new_fields, lag(hour) OVER (PARTITION BY sourcetype ORDER BY hour) AS previous_hour FROM h""")
def field_drift(spark, folder):
    line = R.text("k", F.col("k"), "=1 login=", F.col("login"))
    pairs = each(
        R.typed_events(spark, folder), [F.col("event_type").alias("sourcetype"), "ts"], X.kv_pairs(line), "p")
    news = fields.drift(pairs.select("sourcetype", "ts", F.col("p.name").alias("name")))
    return news.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("hour", "previous_hour")})


@query("field_sketches", f"""
WITH r AS (SELECT event_type AS sourcetype, unnest(['k', 'host']) AS name, unnest([CAST(k AS VARCHAR), host]) AS value FROM ({O.EVENTS})),
counts AS (SELECT sourcetype, name, value, count(*) AS n FROM r GROUP BY ALL)
SELECT sourcetype, name, value, n, count(*) OVER (PARTITION BY sourcetype, name) AS distinct_values,
  CAST(sum(n) OVER (PARTITION BY sourcetype, name) AS BIGINT) AS records,
  max(TRY_CAST(value AS DOUBLE)) OVER (PARTITION BY sourcetype, name) AS largest FROM counts""")
def field_sketches(spark, folder):
    """Sketches per hour, merged; the fields have few values, for which the sketches are exact."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in ("k", "host")])
    records = R.typed_events(spark, folder).select(F.col("event_type").alias("sourcetype"), "ts", F.explode(pairs).alias("p"))
    found = sketches.estimates(sketches.merge(sketches.sketch(records.select("sourcetype", "ts", "p.*"))), top=1000)
    return found.select(
        "sourcetype", "name", F.explode("top").alias("t"), "distinct_values", "records", F.get("quantiles", F.lit(3)).alias("largest")).select(
        "sourcetype", "name", F.col("t.item").alias("value"), F.col("t.count").alias("n"), "distinct_values", "records", "largest")
