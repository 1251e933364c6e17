"""Queries that extract fields from rendered lines; most are checked against the typed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.functions import extract as X
from logsluice.functions import patterns as P
from logsluice.functions.rows import each
from logsluice.operators import fields, rules
from logsluice.operators.rules import Field
from logsluice.plans import oracle_text as O
from logsluice.plans.apply import match_rates
from logsluice.plans.registry import query
from logsluice.sources import lines
from logsluice.sources import rendered as R
from logsluice.sources.tables import table

EV = O.EVENTS
_STAMP = "strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000'"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_SYSLOG = "strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S')"
_MESSAGE = "'event='||event_type||' user='||login||' value: '||val||' code = '||k"
_STATUS = "CASE event_type WHEN 'error' THEN '500' ELSE '200' END"


def _lines(spark, folder, line):
    return R.typed_events(spark, folder).select("event_id", line.alias("raw"))


def _records(df, keys=("event_id",)):
    return each(df, keys, "pairs").select(*keys, "s.name", "s.value")


def _long(values: dict[str, str], where: str = "", key: str = "event_id", source: str = EV) -> str:
    """One row per name from typed columns."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{n}' AS name, CAST({v} AS VARCHAR) AS value FROM ({source}) {where}"
        for n, v in values.items())


# --- JSON, CSV ----------------------------------------------------------------------------------

@query("ext_json_fields", """
SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value, 'number' AS type,
  0.95::DOUBLE AS confidence, false AS is_pii FROM events""")
def ext_json_fields(spark, folder):
    return fields.json_field_records(
        table(spark, folder, "events"), ["event_id"], "props").drop("pos")


@query("ext_json_line", f"""
SELECT event_id, name, value, CASE name WHEN 'timestamp' THEN 'timestamp' WHEN 'user_id' THEN 'number'
  WHEN 'ok' THEN 'boolean' WHEN 'src' THEN 'ip' WHEN 'email' THEN 'email' ELSE 'string' END AS type,
  name = 'email' AS is_pii
FROM ({_long({
    'timestamp': f"{_ISO}||'Z'", 'event': 'event_type', 'user_id': 'user_id',
    'ok': "CASE event_type WHEN 'error' THEN 'false' ELSE 'true' END", 'src': 'ip', 'email': 'email',
    'ctx': "'{{\"host\":\"'||host||'\",\"k\":'||k||'}}'".replace('{{', '{').replace('}}', '}'),
    'tags': "'[\"'||event_type||'\",\"t'||(k%3)||'\"]'"})})""")
def ext_json_line(spark, folder):
    return fields.json_field_records(
        _lines(spark, folder, R.json_line()), ["event_id"], "raw").select(
        "event_id", "name", "value", "type", "is_pii")


@query("ext_json_nested", f"""
SELECT event_id, event_type AS event, user_id, k AS "ctx.k", host AS "ctx.host", unnest([event_type, 't'||(k%3)]) AS tags
FROM ({EV})""")
def ext_json_nested(spark, folder):
    return fields.flatten_json(
        _lines(spark, folder, R.json_line()), ["event_id"], "raw",
        "event string, user_id bigint, ctx struct<k:bigint,host:string>, tags array<string>")


@query("ext_json_profiled", f"""
SELECT event_id, k AS "ctx.k", host AS "ctx.host", email, event_type AS event, event_type <> 'error' AS ok,
  ip AS src, {_ISO}||'Z' AS timestamp, user_id, unnest([event_type, 't'||(k%3)]) AS tags FROM ({EV})""")
def ext_json_profiled(spark, folder):
    """The schema comes from the lines themselves."""
    rendered = _lines(spark, folder, R.json_line())
    return fields.flatten_json(
        rendered, ["event_id"], "raw", fields.nested_json_schema(rendered, "raw"))


@query("ext_json_arrays", f"""
SELECT event_id, k AS "AVOID", [event_type, 't'||(k%3), NULL][i] AS tags, [user_id, k, 7][i] AS nums,
  ['a', host, NULL][i] AS "items.name", [1, k, NULL][i] AS "items.size.n"
FROM ({EV}), (SELECT unnest([1, 2, 3]) AS i)""")
def ext_json_arrays(spark, folder):
    """Two arrays and an array of objects side by side, and a key that looks like a type."""
    line = R.text(
        '{"AVOID":', F.col("k"), ',"tags":["', F.col("event_type"), '","t', F.col("k") % 3, '"],"nums":[', F.col("user_id"),
        ",", F.col("k"), ',7],"items":[{"name":"a","size":{"n":1}},{"name":"', F.col("host"), '","size":{"n":', F.col("k"),
        "}}]}")
    rendered = _lines(spark, folder, line)
    return fields.flatten_json(rendered, ["event_id"], "raw", fields.nested_json_schema(rendered, "raw"))


@query("ext_preview_all", f"SELECT event_id, login||'|'||val||'|'||event_type AS found FROM ({EV})")
def ext_preview_all(spark, folder):
    """All matches of a field pattern in a line; empty ones are left out."""
    line = R.text("a=", F.col("login"), " b=", F.col("val"), " c= d=", F.col("event_type"))
    return _lines(spark, folder, line).select(
        "event_id", F.array_join(X.preview_values(F.col("raw"), r"[a-z]=(?P<value>[^\s]*)", "value"), "|").alias("found"))


@query("ext_csv", f"""
SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, event_type AS kind,
  'said "'||login||'", then left' AS note, val, NULL::VARCHAR AS empty FROM ({EV})""")
def ext_csv(spark, folder):
    row = lines.csv_fields(
        F.col("raw"), "id bigint, stamp string, kind string, note string, val string, empty string")
    return _lines(spark, folder, R.csv_line()).select(row.alias("r")).select("r.*")


# --- Access logs and syslog ---------------------------------------------------------------------

@query("ext_apache_common", f"""
SELECT event_id, ip AS clientip, '-' AS ident, login AS auth, {_STAMP} AS timestamp,
  'GET /'||event_type||'/'||k||' HTTP/1.1' AS request, {_STATUS} AS status,
  CAST(user_id*10+k AS VARCHAR) AS bytes, 'GET' AS method, '/'||event_type||'/'||k AS uri, 'HTTP/1.1' AS protocol
FROM ({EV})""")
def ext_apache_common(spark, folder):
    return X.apache_common(_lines(spark, folder, R.apache_line())).drop("raw")


@query("ext_apache_extended", f"""
SELECT event_id, ip AS clientip, '-' AS ident, login AS auth, {_STAMP} AS timestamp, 'POST' AS method,
  '/'||event_type AS uri, 'HTTP/1.1' AS protocol, {_STATUS} AS status,
  CASE WHEN k % 10 = 0 THEN '-' ELSE CAST(user_id*10 AS VARCHAR) END AS bytes,
  CASE WHEN k % 2 = 0 THEN 'http://ref.example.com/'||k END AS referer,
  CASE WHEN k % 2 = 0 THEN 'agent/'||k END AS useragent, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS req_time,
  NULL::VARCHAR AS cookie, NULL::VARCHAR AS "respTime", NULL::VARCHAR AS version
FROM ({EV})""")
def ext_apache_extended(spark, folder):
    return X.apache_access(_lines(spark, folder, R.apache_access_line())).drop("raw")


@query("ext_syslog_std", f"""
SELECT event_id, {_SYSLOG} AS timestamp, host, {_MESSAGE} AS message FROM ({EV})""")
def ext_syslog_std(spark, folder):
    return X.syslog_standard(_lines(spark, folder, R.syslog_line())).drop("raw")


@query("ext_syslog_3164", f"""
SELECT event_id, CAST(k+1 AS VARCHAR) AS priority, {_SYSLOG} AS timestamp, host, {_MESSAGE} AS message,
  CAST((k+1)//8 AS INTEGER) AS facility, CAST((k+1)%8 AS INTEGER) AS severity FROM ({EV})""")
def ext_syslog_3164(spark, folder):
    return X.syslog_3164(_lines(spark, folder, R.syslog_3164_line())).drop("raw")


@query("ext_syslog_5424", f"""
SELECT event_id, CAST(k+1 AS VARCHAR) AS priority, '1' AS version, {_ISO}||'Z' AS timestamp, host,
  'app'||(k%5) AS app_name, CAST(user_id AS VARCHAR) AS proc_id, 'ID'||k AS msg_id, {_MESSAGE} AS message,
  CAST((k+1)//8 AS INTEGER) AS facility, CAST((k+1)%8 AS INTEGER) AS severity FROM ({EV})""")
def ext_syslog_5424(spark, folder):
    return X.syslog_5424(_lines(spark, folder, R.syslog_5424_line())).drop("raw")


# --- Pairs --------------------------------------------------------------------------------------

_KV = {"ts": _ISO, "user": "login", "email": "email", "client_ip": "ip", "event": "event_type", "value": "val"}


@query("ext_kv", _long(_KV))
def ext_kv(spark, folder):
    return _records(_lines(spark, folder, R.kv_line()).select(
        "event_id", X.kv_pairs(F.col("raw")).alias("pairs")))


@query("ext_kv_orders", " UNION ALL ".join(
    f"SELECT o_orderkey, '{n}' AS name, {v} AS value FROM orders" for n, v in {
        "id": "CAST(o_orderkey AS VARCHAR)", "status": "o_orderstatus", "total": "printf('%.2f', o_totalprice)"}.items()))
def ext_kv_orders(spark, folder):
    raw = R.text("id=", F.col("o_orderkey"), ' status="', F.col("o_orderstatus"), '" total=',
                 F.format_string("%.2f", "o_totalprice"), ' prio="', F.lit("two words"), '"')
    return _records(
        table(spark, folder, "orders").select("o_orderkey", X.kv_pairs(raw).alias("pairs")), ["o_orderkey"])


@query("ext_kv_dialects", _long({"event": "event_type", "user": "login", "value": "val", "code": "k"}))
def ext_kv_dialects(spark, folder):
    message = X.syslog_standard(_lines(spark, folder, R.syslog_line()))
    return _records(message.select("event_id", X.kv_dialects(F.col("message")).alias("pairs")))


@query("ext_kv_quoted", _long({"user": "login||' of '||host", "event": "event_type", "value": "val"}))
def ext_kv_quoted(spark, folder):
    return _records(_lines(spark, folder, R.kv_quoted_line()).select(
        "event_id", X.first_per_name(X.kv_quoted(F.col("raw"))).alias("pairs")))


# --- XML ----------------------------------------------------------------------------------------

@query("ext_xml_tags", _long({"id": "event_id", "type": "event_type", "user": "login"}))
def ext_xml_tags(spark, folder):
    return _records(_lines(spark, folder, R.xml_simple_line()).select(
        "event_id", X.xml_simple(F.col("raw")).alias("pairs")))


@query("ext_xml_selfclosing", _long({"event_id": "event_id", "user_name": "login"}))
def ext_xml_selfclosing(spark, folder):
    return _records(_lines(spark, folder, R.xml_self_closing_line()).select(
        "event_id", X.xml_self_closing(F.col("raw")).alias("pairs")))


@query("ext_xml_attrs", rf"""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, {O.lit(P.XML_WITH_ATTRIBUTES)})) AS m FROM pages),
t AS (SELECT page_id, regexp_extract(m, {O.lit(P.XML_WITH_ATTRIBUTES)}, 1) AS tag,
  regexp_extract(m, {O.lit(P.XML_WITH_ATTRIBUTES)}, 2) AS body, regexp_extract(m, {O.lit(P.XML_WITH_ATTRIBUTES)}, 3) AS content
  FROM m)
SELECT page_id, tag||'_'||regexp_extract(a, {O.lit(P.XML_ATTRIBUTE)}, 1) AS name,
  regexp_extract(a, {O.lit(P.XML_ATTRIBUTE)}, 2) AS value
FROM (SELECT page_id, tag, unnest(regexp_extract_all(body, {O.lit(P.XML_ATTRIBUTE)})) AS a FROM t)
UNION ALL SELECT page_id, tag, content FROM t""")
def ext_xml_attrs(spark, folder):
    return _records(table(spark, folder, "pages").select(
        "page_id", X.xml_with_attributes(F.col("html")).alias("pairs")), ["page_id"])


@query("ext_xml_auto", " UNION ALL ".join([
    _long({"id": "event_id", "type": "event_type", "user": "login"}, "WHERE k % 3 = 0"),
    _long({"event_id": "event_id", "user_name": "login"}, "WHERE k % 3 = 1"),
    _long({"event_id": "event_id", "event_type": "event_type", "event": "login"}, "WHERE k % 3 = 2")]))
def ext_xml_auto(spark, folder):
    line = F.when(F.col("k") % 3 == 0, R.xml_simple_line()).when(
        F.col("k") % 3 == 1, R.xml_self_closing_line()).otherwise(R.xml_attributes_line())
    return _records(_lines(spark, folder, line).select(
        "event_id", X.xml_auto(F.col("raw")).alias("pairs")))


# --- User patterns ------------------------------------------------------------------------------

_LINK = r'href="(?P<link_path>[^"]+)">(?P<link_text>[^<]*)<'
_LINK_PLAIN = O.lit('href="([^"]+)">([^<]*)<')


@query("ext_regex_named", f"""
WITH g AS (SELECT page_id, list_filter(regexp_extract_all(html, {_LINK_PLAIN}, 1), lambda x: x <> '') AS a,
  list_filter(regexp_extract_all(html, {_LINK_PLAIN}, 2), lambda x: x <> '') AS b FROM pages)
SELECT page_id, 'link_path' AS name, a[1] AS value, 0.9::DOUBLE AS confidence FROM g WHERE len(a) > 0
UNION ALL SELECT page_id, 'link_text', b[1], 0.9::DOUBLE FROM g WHERE len(b) > 0""")
def ext_regex_named(spark, folder):
    found = table(spark, folder, "pages").select(
        "page_id", X.named_group_pairs(F.col("html"), _LINK).alias("pairs"))
    return fields.field_records(
        found, ["page_id"], source=fields.CUSTOM, confidence=P.CONFIDENCE["regex_named"], from_regex=True,
    ).select("page_id", "name", "value", "confidence")


@query("ext_regex_numbered", f"""
WITH g AS (SELECT page_id, regexp_extract(url, '(https?)://([^/]+)(/[a-z]{{2}}/)?', [1, 2, 3]) IS NOT NULL AS ok,
  regexp_extract(url, '(https?)://([^/]+)(/[a-z]{{2}}/)?', 1) AS a,
  regexp_extract(url, '(https?)://([^/]+)(/[a-z]{{2}}/)?', 2) AS b,
  regexp_extract(url, '(https?)://([^/]+)(/[a-z]{{2}}/)?', 3) AS c FROM pages)
SELECT page_id, name, value FROM (
  SELECT page_id, 'extracted_field_1' AS name, a AS value FROM g
  UNION ALL SELECT page_id, 'extracted_field_2', b FROM g UNION ALL SELECT page_id, 'extracted_field_3', c FROM g)
WHERE value <> ''""".replace("regexp_extract(url, '(https?)://([^/]+)(/[a-z]{2}/)?', [1, 2, 3]) IS NOT NULL AS ok,", ""))
def ext_regex_numbered(spark, folder):
    found = table(spark, folder, "pages").select("page_id", X.numbered_group_pairs(
        F.col("url"), r"(https?)://([^/]+)(/[a-z]{2}/)?").alias("pairs"))
    return _records(found, ["page_id"])


@query("ext_regex_matches", """
WITH m AS (SELECT page_id, regexp_extract_all(html, '<h[1-6]>') AS m FROM pages)
SELECT page_id, 'regex_match_' || i AS name, m[i] AS value FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)""")
def ext_regex_matches(spark, folder):
    found = table(spark, folder, "pages").select(
        "page_id", X.match_pairs(F.col("html"), "<h[1-6]>").alias("pairs"))
    return _records(found, ["page_id"])


@query("ext_generic", f"""
SELECT doc_id, {', '.join(f"nullif(regexp_extract(text, {O.lit(p)}, 1), '') AS {n}" for n, p in P.GENERIC_PATTERNS.items())}
FROM documents""")
def ext_generic(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", *[c.alias(n) for n, c in X.generic_fields(F.col("text")).items()])


_PREVIEW = {"lang_code": r"/(?P<lang_code>[a-z]{2})/", "page_no": r"page=(\d+)", "secure": r"https://"}


@query("ext_match_rate", " UNION ALL ".join(
    f"SELECT count(*) AS lines, '{n}' AS field, count(*) FILTER (regexp_matches(url, {O.lit(p)})) AS matched, "
    f"round(count(*) FILTER (regexp_matches(url, {O.lit(p)})) / count(*), 4) AS match_rate FROM pages"
    for n, p in {"lang_code": "/([a-z]{2})/", "page_no": r"page=(\d+)", "secure": "https://"}.items()))
def ext_match_rate(spark, folder):
    from logsluice.functions.regexlang import split_named_groups

    patterns = {n: split_named_groups(p)[0] for n, p in _PREVIEW.items()}
    return match_rates(table(spark, folder, "pages"), patterns, "url")


@query("ext_preview", """
SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang_code,
  nullif(regexp_extract(url, 'page=(\\d+)', 1), '') AS page_no, nullif(regexp_extract(url, 'https://'), '') AS secure
FROM pages""")
def ext_preview(spark, folder):
    return table(spark, folder, "pages").select("page_id", *[
        X.preview_value(F.col("url"), p, n).alias(n) for n, p in _PREVIEW.items()])


@query("ext_combined", f"""
SELECT event_id, 1::BIGINT AS match, event_type AS key_a, login AS key_b FROM ({EV})
UNION ALL SELECT event_id, 2, val, CAST(k AS VARCHAR) FROM ({EV})""")
def ext_combined(spark, folder):
    line = R.text("[", F.col("event_type"), "|", F.col("login"), "] and [", F.col("val"), "|", F.col("k"), "]")
    found = each(_lines(spark, folder, line), ["event_id"], X.combined_records(
        F.col("raw"), r"\[(?<key_a>[^|\]]+)\|(?<key_b>[^|\]]+)\]"), "r", "i")
    return found.select(
        "event_id", (F.col("i") + 1).cast("bigint").alias("match"),
        F.get("r", 0).alias("key_a"), F.get("r", 1).alias("key_b"))


@query("ext_sample_values", """
SELECT source, arg_min(v, doc_id) FILTER (v IS NOT NULL) AS value FROM (
  SELECT source, doc_id, nullif(regexp_extract(text, '@mail(\\d)', 1), '') AS v FROM documents) GROUP BY source""")
def ext_sample_values(spark, folder):
    return fields.sample_values(
        table(spark, folder, "documents"), "source", "doc_id", "text", {"value": r"@mail(?<host_no>\d)"})


# --- Compiled patterns --------------------------------------------------------------------------

def _apply_pattern(df, extraction):
    return X.with_groups(df, extraction.pattern, extraction.names).drop("raw")


@query("ext_by_type", f"SELECT event_id, ip AS client_ip, email, login AS who, event_type AS kind FROM ({EV})")
def ext_by_type(spark, folder):
    line = R.text("from ", F.col("ip"), " <", F.col("email"), "> who=", F.col("login"), ', "kind":"',
                  F.col("event_type"), '"')
    sample = 'who=x, "kind":"y"'
    out = _lines(spark, folder, line)
    lead = {"who": "who=", "kind": '"kind":'}
    for f in (Field("client_ip", "ip"), Field("email", "email"), Field("who"), Field("kind")):
        out = out.withColumn(f.name, X.empty_to_null(F.regexp_extract(
            "raw", lead.get(f.name, "") + rules.pattern_by_type(f, sample), 1)))
    return out.drop("raw")


_KV_FIELDS = [Field("value"), Field("client_ip", "ip"), Field("user"), Field("event"), Field("absent")]


@query("ext_built_kv", f"""
SELECT event_id, {_ISO} AS timestamp, login AS user, ip AS client_ip, event_type AS event, val AS value FROM ({EV})""")
def ext_built_kv(spark, folder):
    rendered = _lines(spark, folder, R.kv_line())
    sample = rendered.limit(1)
    ordered = rules.fields_in_line_order(sample, _KV_FIELDS)
    return _apply_pattern(rendered, rules.kv_pattern(ordered, rules.timestamp_pattern(sample)))


@query("ext_built_json", f"SELECT event_id, {_ISO}||'Z' AS timestamp, event_type AS event, ip AS src, email FROM ({EV})")
def ext_built_json(spark, folder):
    extraction = rules.json_pattern([
        Field("timestamp", "timestamp"), Field("event"), Field("src", "ip"), Field("email", "email")])
    return _apply_pattern(_lines(spark, folder, R.json_line()), extraction)


@query("ext_built_csv", f"SELECT event_id, {_ISO} AS stamp, ip AS src, email, event_type AS kind FROM ({EV})")
def ext_built_csv(spark, folder):
    line = R.text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), ", ", F.col("ip"), ",", F.col("email"), ",",
                  F.col("event_type"))
    extraction = rules.csv_pattern([
        Field("stamp", "timestamp"), Field("src", "ip"), Field("email", "email"), Field("kind")])
    return _apply_pattern(_lines(spark, folder, line), extraction)


@query("ext_built_generic", f"SELECT event_id, ip AS src, email AS mail, login AS who FROM ({EV})")
def ext_built_generic(spark, folder):
    line = R.text("at ", F.col("ip"), " ", F.col("email"), " ", F.col("login"), " end")
    extraction = rules.generic_pattern([Field("src", "ip"), Field("mail", "email"), Field("who")])
    return _apply_pattern(_lines(spark, folder, line), extraction)


@query("ext_selected", f"SELECT event_id, ip AS client_ip, val AS value FROM ({EV})")
def ext_selected(spark, folder):
    rendered = _lines(spark, folder, R.kv_line())
    wanted = [
        Field("value", regex=r"value=(?<value>\d+\.\d+)"), Field("user", regex=r"(?<user>user\d+)"),
        Field("client_ip", regex=r"(?P<client_ip>10(?:\.\d+){3})")]
    sample = rendered.limit(1)
    return _apply_pattern(rendered, rules.selected_pattern(sample, wanted, ["client_ip", "value"]))
