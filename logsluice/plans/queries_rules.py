"""Queries that compile, apply and validate rule specifications, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.functions import extract as X
from logsluice.functions import patterns as P
from logsluice.functions.rows import each
from logsluice.operators import pii, redaction
from logsluice.operators.detectors import DETECTORS, canonical_type
from logsluice.operators.formats import detect_line_format
from logsluice.operators.rules import Extraction
from logsluice.plans import apply as A
from logsluice.plans import oracle_text as O
from logsluice.plans.profile import profile
from logsluice.plans.queries_fields import CSV_HEADER, rendered
from logsluice.plans.registry import query
from logsluice.plans.spec import OnboardingSpec, TimeSettings
from logsluice.sources import rendered as R
from logsluice.sources.tables import table
from logsluice.streaming import onboard as SO
from logsluice.streaming import windows as SW

EV = O.EVENTS

KV_SPEC = OnboardingSpec(
    sourcetype="kv", kind="kv", fields=["ts", "user", "email", "client_ip", "event", "value"],
    time=TimeSettings("%Y-%m-%dT%H:%M:%S", "ts=", 25),
    mapping=[("client_ip", "src_ip"), ("event", "action"), ("user", "user"), ("value", "")],
    detectors=["EmailDetector"], field_rules=[("client_ip", r"\.\d+$", ".[REDACTED_HOST]")],
    custom_patterns=[("login name", r"user\d{3}")])
APACHE_SPEC = OnboardingSpec(
    sourcetype="apache", kind="pattern", fields=P.APACHE_COMMON_NAMES,
    extraction=Extraction(P.APACHE_COMMON, tuple(P.APACHE_COMMON_NAMES)),
    time=TimeSettings("%d/%b/%Y:%H:%M:%S %z", r"\[", 29),
    mapping=[("clientip", "src_ip"), ("auth", "user")], rename=True, detectors=["IpAddressDetector"],
    existing=["ident"])
JSON_SPEC = OnboardingSpec(
    sourcetype="json", kind="json", fields=["timestamp", "event", "src", "email", "ctx"],
    time=TimeSettings("%Y-%m-%dT%H:%M:%S", '"timestamp":"', 25), mapping=[("src", "src_ip")],
    detectors=["EmailDetector", "IpAddressDetector"])
CSV_SPEC = OnboardingSpec(
    sourcetype="csv", kind="csv", fields=CSV_HEADER,
    time=TimeSettings("%Y-%m-%d %H:%M:%S", r"^\d+,", 25), mapping=[("kind", "action")])
XML_SPEC = OnboardingSpec(sourcetype="xml", kind="xml", fields=["id", "type", "user"])
SYSLOG_SPEC = OnboardingSpec(
    sourcetype="syslog", kind="pattern", fields=P.SYSLOG_STANDARD_NAMES,
    extraction=Extraction(P.SYSLOG_STANDARD, tuple(P.SYSLOG_STANDARD_NAMES)),
    time=TimeSettings("%b %d %H:%M:%S", "^", 15))
SPECS = [APACHE_SPEC, JSON_SPEC, CSV_SPEC, KV_SPEC, SYSLOG_SPEC, XML_SPEC]

_LOGIN = "CASE WHEN regexp_matches(login, 'user\\d{3}') THEN regexp_replace(login, 'user\\d{3}', '[REDACTED_LOGIN_NAME]') ELSE login END"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_IP3 = "regexp_replace(ip, '\\.\\d+$', '.[REDACTED_HOST]')"
_KV_RAW = (f"'ts='||{_ISO}||' user='||{_LOGIN}||' email=\"[REDACTED_EMAIL]\" client_ip='||ip||' event='"
           "||event_type||' value='||val")
_KV_COLUMNS = f"""event_id, {_KV_RAW} AS raw, {_ISO} AS ts, {_LOGIN} AS "user", '[REDACTED_EMAIL]' AS email,
  {_IP3} AS client_ip, event_type AS event, val AS value, date_trunc('second', ts) AS event_time,
  {_IP3} AS src_ip, event_type AS action"""


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("onboard_kv", f"SELECT {_KV_COLUMNS} FROM ({EV})")
def onboard_kv(spark, folder):
    lines = R.typed_events(spark, folder).select("event_id", R.kv_line().alias("raw"))
    return _ntz(A.apply(lines, KV_SPEC), "event_time")


@query("onboard_apache", f"""
SELECT event_id, '[REDACTED_IP_ADDRESS] - '||login||' ['||strftime(ts, '%d/%b/%Y:%H:%M:%S')||' +0000] "GET /'||event_type
  ||'/'||k||' HTTP/1.1" '||CASE event_type WHEN 'error' THEN 500 ELSE 200 END||' '||(user_id*10+k) AS raw,
  '[REDACTED_IP_ADDRESS]' AS src_ip, login AS "user", strftime(ts, '%d/%b/%Y:%H:%M:%S')||' +0000' AS timestamp,
  'GET /'||event_type||'/'||k||' HTTP/1.1' AS request, CASE event_type WHEN 'error' THEN '500' ELSE '200' END AS status,
  CAST(user_id*10+k AS VARCHAR) AS bytes, date_trunc('second', ts) AS event_time FROM ({EV})""")
def onboard_apache(spark, folder):
    lines = R.typed_events(spark, folder).select("event_id", R.apache_line().alias("raw"))
    return _ntz(A.apply(lines, APACHE_SPEC), "event_time")


@query("onboard_all", f"""
SELECT event_id, CASE sourcetype WHEN 'xml' THEN NULL ELSE date_trunc('second', ts) END AS event_time,
  CASE sourcetype WHEN 'json' THEN event_type WHEN 'csv' THEN event_type WHEN 'kv' THEN event_type END AS action,
  CASE sourcetype WHEN 'apache' THEN '[REDACTED_IP_ADDRESS]' WHEN 'json' THEN '[REDACTED_IP_ADDRESS]'
    WHEN 'kv' THEN {_IP3} END AS src_ip,
  CASE sourcetype WHEN 'apache' THEN login WHEN 'kv' THEN {_LOGIN} WHEN 'xml' THEN login END AS "user",
  CASE sourcetype WHEN 'syslog' THEN host END AS host
FROM ({EV})""")
def onboard_all(spark, folder):
    """Six sourcetypes, each by its own rules, into one normalised table."""
    events = rendered(spark, folder).select("event_id", "sourcetype", "raw")
    done = A.apply_all(events, SPECS, ["event_id", "sourcetype"])
    # The rendered years are 2024; a line without a year takes that of its ingest, so only the
    # day and time are compared for syslog. XML lines carry no time at all.
    moment = F.when(F.col("sourcetype") == "xml", F.lit(None)).otherwise(F.col("event_time"))
    stamp = F.when(
        F.col("sourcetype") == "syslog",
        F.make_timestamp(F.lit(2024), F.month(moment), F.dayofmonth(moment), F.hour(moment),
                         F.minute(moment), F.second(moment))).otherwise(moment)
    pick = lambda n: F.col("fields")[n]
    return done.select(
        "event_id", stamp.cast("timestamp_ntz").alias("event_time"),
        F.coalesce(pick("action"), pick("event")).alias("action"), pick("src_ip").alias("src_ip"),
        pick("user").alias("user"), pick("host").alias("host"))


_RULES = [r for s in SPECS for r in s.rules()]


@query("rules_table", f"""
WITH r AS (SELECT * FROM (VALUES {', '.join(
    f"({O.lit(s)}, {i}, {O.lit(k)}, {O.lit(f)}, {O.lit(p)}, {O.lit(t)})" for s, i, k, f, p, t in _RULES)})
  AS t(sourcetype, seq, kind, field, pattern, target)),
n AS (SELECT sourcetype, count(*) AS lines FROM ({EV}) GROUP BY 1)
SELECT sourcetype, CAST(seq AS INTEGER) AS seq, kind, field, pattern, target, lines FROM r JOIN n USING (sourcetype)""")
def rules_table(spark, folder):
    """The rules of all sourcetypes with the number of lines each applies to."""
    from logsluice.plans.spec import rules_table as build

    lines = rendered(spark, folder).groupBy("sourcetype").agg(F.count("*").alias("lines"))
    return build(spark, SPECS).join(lines, "sourcetype")


@query("validate_rules", f"""
WITH c AS (SELECT count(*) AS lines, count(*) FILTER (sourcetype = 'kv') AS kv FROM ({EV})),
v AS (SELECT unnest(['ts', 'user', 'email', 'client_ip', 'event', 'value', 'event_time']) AS field)
SELECT lines, field, CASE WHEN field IN ('user', 'event', 'value') THEN kv + (SELECT count(*) FROM ({EV}) WHERE
    sourcetype = 'syslog' AND field IN ('user', 'event')) ELSE kv END AS matched,
  round(CASE WHEN field IN ('user', 'event', 'value') THEN kv + (SELECT count(*) FROM ({EV}) WHERE
    sourcetype = 'syslog' AND field IN ('user', 'event')) ELSE kv END / lines, 4) AS match_rate
FROM c, v""")
def validate_rules(spark, folder):
    """The pair rules against all lines: pairs also occur in syslog messages."""
    return A.validate(rendered(spark, folder).select("event_id", "raw"), KV_SPEC)


@query("profile_and_apply", f"""
SELECT event_id, CASE WHEN sourcetype IN ('apache', 'kv', 'json') THEN ip END AS src_ip,
  CASE WHEN sourcetype IN ('json', 'kv', 'apache', 'csv') THEN date_trunc('second', ts) END AS event_time FROM ({EV})""")
def profile_and_apply(spark, folder):
    """Specifications inferred from the lines, then applied to them."""
    events = rendered(spark, folder).select("event_id", "sourcetype", "raw")
    specs = profile(events, model="web", headers={"csv": CSV_HEADER})
    done = A.apply_all(events, specs, ["event_id", "sourcetype"])
    timed = F.when(F.col("sourcetype").isin("json", "kv", "apache", "csv"), F.col("event_time"))
    return done.select(
        "event_id", F.col("fields")["src_ip"].alias("src_ip"),
        timed.cast("timestamp_ntz").alias("event_time"))


_ZONED = "strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S')||'+02:00'"
_MESSAGE = "'event='||event_type||' user='||login||' value: '||val||' code = '||k"
_IN_MESSAGE = "'code='||k, 'event='||event_type, 'user='||login, 'value='||val"
_SYSLOG_STAMP = "strftime(ts, '%b ')||lpad(CAST(day(ts) AS VARCHAR), 2, ' ')||strftime(ts, ' %H:%M:%S')"


@query("profile_and_apply_all", f"""
WITH e AS (SELECT *, event_id % 8 AS turn FROM ({EV})),
f AS (SELECT *, CASE turn
  WHEN 0 THEN ['clientip='||ip, 'ident=-', 'auth='||login, 'timestamp='||strftime(ts, '%d/%b/%Y:%H:%M:%S')||' +0000',
    'method=GET', 'uri=/'||event_type, 'protocol=HTTP/1.1', 'status=200', 'bytes='||k, 'referer=-',
    'useragent=Mozilla/5.0 (KHTML, like Gecko)']
  WHEN 1 THEN ['user='||login||',', 'ip='||ip||',', 'ok=1', 'at='||{_ZONED}]
  WHEN 2 THEN ['pad='||repeat('x, ', 120), 'timestamp='||strftime(ts, '%Y-%m-%dT%H:%M:%S')||'.5Z', 'event='||event_type]
  WHEN 3 THEN ['priority='||(k+1), 'timestamp='||{_SYSLOG_STAMP}, 'host='||host, 'message='||{_MESSAGE}, {_IN_MESSAGE}]
  WHEN 4 THEN ['priority='||(k+1), 'version=1', 'timestamp='||strftime(ts, '%Y-%m-%dT%H:%M:%S')||'Z', 'host='||host,
    'app_name=app'||(k%5), 'proc_id='||user_id, 'msg_id=ID'||k, 'message='||{_MESSAGE}, {_IN_MESSAGE}]
  WHEN 5 THEN ['column_1='||event_id, 'column_2='||strftime(ts, '%Y-%m-%d %H:%M:%S'), 'column_3='||event_type,
    'column_4=said "'||login||'", then left', 'column_5='||val]
  WHEN 6 THEN ['kind='||event_type, 'ts='||{_ZONED}] ELSE [] END AS pairs FROM e)
SELECT event_id, CASE turn WHEN 7 THEN NULL WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')||'.5'
  WHEN 3 THEN strftime(ts, '%m-%d %H:%M:%S')||'.0' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S')||'.0' END AS event_time,
  array_to_string(list_sort(pairs), '; ') AS fields,
  CASE turn WHEN 7 THEN 'mail [REDACTED_EMAIL] at [REDACTED_IP_ADDRESS]' END AS raw_without_spec,
  CASE turn WHEN 7 THEN 'no specification' END AS error FROM f""")
def profile_and_apply_all(spark, folder):
    """Every line, every field and the whole time of lines that are easily misread; the last sourcetype
    was not profiled."""
    events = R.hard_events(spark, folder).select("event_id", "sourcetype", "raw")
    specs = profile(events.filter(~F.col("sourcetype").eqNullSafe("other")))
    done = A.apply_all(events, specs, ["event_id", "sourcetype"])
    # A line without a year takes that of its ingest.
    form = F.when(F.col("sourcetype") == "old", F.date_format("event_time", "MM-dd HH:mm:ss.S")).otherwise(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.S"))
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done.select(
        "event_id", form.alias("event_time"), F.array_join(F.array_sort(pairs), "; ").alias("fields"),
        F.when(F.col("error").isNotNull(), F.col("raw")).alias("raw_without_spec"), "error")


# --- Extension points ---------------------------------------------------------------------------

@query("sql_functions", f"""
SELECT event_id, 'email' AS kind, true AS flag, 'mail [REDACTED_EMAIL] from [REDACTED_IP_ADDRESS]' AS clean FROM ({EV})""")
def sql_functions(spark, folder):
    """The functions registered for SQL users."""
    from logsluice.functions.register import register

    register(spark)
    R.typed_events(spark, folder).select("event_id", "email", "ip").createOrReplaceTempView("_sluice_events")
    return spark.sql("""
        SELECT event_id, infer_field_type(email) AS kind, pii_flag('contact', email) AS flag,
          redact(concat('mail ', email, ' from ', ip)) AS clean FROM _sluice_events""")


@query("sql_pii_spans", f"""
SELECT event_id, 'EmailDetector' AS type, email AS text FROM ({EV})
UNION ALL SELECT event_id, 'IpAddressDetector', ip FROM ({EV})""")
def sql_pii_spans(spark, folder):
    """The span function of SQL users, one row per span."""
    from logsluice.functions.register import register

    register(spark)
    R.typed_events(spark, folder).select(
        "event_id", R.text("mail ", F.col("email"), " from ", F.col("ip")).alias("raw"),
    ).createOrReplaceTempView("_sluice_lines")
    return spark.sql("""
        SELECT event_id, s.type, s.text FROM (SELECT event_id, pii_spans(raw) AS spans FROM _sluice_lines)
        LATERAL VIEW OUTER explode(spans) v AS s WHERE s IS NOT NULL""")


@query("sql_pii_spans_in_context", """
SELECT c_custkey, 'pw'||lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')||'x' AS text,
  CAST(strpos(note, 'password=') + 8 AS BIGINT) AS start_pos, CAST(length(note) AS BIGINT) AS end_pos, 1.0::DOUBLE AS score
FROM (SELECT c_custkey, c_name||' born 19'||lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')||'-'
  ||lpad(CAST((c_custkey % 9 + 1) % 100 AS VARCHAR), 2, '0')||'-'||lpad(CAST((c_custkey % 28 + 1) % 100 AS VARCHAR), 2, '0')
  ||', licence ABCDE'||lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')||'AB'||(c_custkey % 10)||'XY, code SW'
  ||(c_custkey % 9 + 1)||'A '||(c_custkey % 10)||'AA, number AB'||lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')
  ||'C, ref 12345 '||lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')||', plate AB'
  ||lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')||' CDE, by @cust'||c_custkey||' skype: live.user'||c_custkey
  ||' password=pw'||lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')||'x' AS note FROM customer)""")
def sql_pii_spans_in_context(spark, folder):
    """The span function with offsets; a credential is the value without what leads to it."""
    from logsluice.functions.register import register

    register(spark)
    R.customer_notes(spark, folder).createOrReplaceTempView("_sluice_notes")
    return spark.sql("""
        SELECT c_custkey, s.text, CAST(s.start AS BIGINT) AS start_pos, CAST(s.end AS BIGINT) AS end_pos, s.score
        FROM (SELECT c_custkey, pii_spans(note) AS spans FROM _sluice_notes)
        LATERAL VIEW OUTER explode(spans) v AS s WHERE s.type = 'CredentialDetector'""")


@query("custom_detector_class", O.spans("documents", ["doc_id"], "text", ["EmailDetector"]).replace(
    "'EmailDetector' AS type", "'MailFinder' AS type").replace("0 AS ord", "0 AS ord").replace(
    "SELECT doc_id, CAST", "SELECT doc_id, CAST", 1))
def custom_detector_class(spark, folder):
    """A detector written in Python, batch-wise over Arrow, beside the pattern detectors."""
    from logsluice.functions.python_detector import PatternFinder, detect_with

    docs = table(spark, folder, "documents").select("doc_id", "text")
    finder = PatternFinder("MailFinder", DETECTORS["EmailDetector"].pattern)
    rows = each(docs, ["doc_id"], detect_with(finder)(F.col("text"))).select("doc_id", "s.*")
    return rows.select(
        "doc_id", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"),
        "ord", "type", "text")


# --- Windows over tables ------------------------------------------------------------------------

def _event_lines(events):
    """A line per event in which errors carry an address and the others an e-mail."""
    ip = R.text("10.0.", F.col("user_id") % 256, ".", F.col("event_id") % 250)
    line = F.when(F.col("event_type") == "error", R.text("from ", ip)).when(
        F.col("event_type") == "signup", R.text("mail user", F.col("user_id"), "@mail.example.com via ", ip)
    ).otherwise("nothing")
    return events.withColumn("raw", line)


def _pii_per_event(events):
    found = pii.with_spans(
        _event_lines(events), "raw", [DETECTORS["EmailDetector"], DETECTORS["IpAddressDetector"]])
    return each(found, ["ts"], "spans").select("ts", canonical_type(F.col("s.type")).alias("type"))


_RATE = """
SELECT date_trunc('hour', ts) AS start_ts, type, count(*) AS items FROM (
  SELECT ts, 'IP_ADDRESS' AS type FROM events WHERE event_type IN ('error', 'signup')
  UNION ALL SELECT ts, 'EMAIL' FROM events WHERE event_type = 'signup')"""
_CLOSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {0}) - INTERVAL 10 MINUTE"


def _window_rows(df):
    return _ntz(SW.flat_window(df).drop("end_ts"), "start_ts")


@query("win_pii_rate", f"{_RATE} GROUP BY ALL")
def win_pii_rate(spark, folder):
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _window_rows(SW.rate_per_window(_pii_per_event(events), ["type"]))


@query("win_sliding_failures", """
WITH s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS start_ts, event_type
  FROM events, (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT start_ts, count(*) AS events, count(*) FILTER (event_type = 'error') AS failures,
  round(count(*) FILTER (event_type = 'error') / count(*), 4) AS rate FROM s GROUP BY start_ts""")
def win_sliding_failures(spark, folder):
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _window_rows(SW.failure_rate(events, F.col("event_type") == "error"))


@query("win_format_failures", f"""
WITH s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS start_ts, sourcetype
  FROM ({EV}), (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT start_ts, count(*) AS events, count(*) FILTER (sourcetype = 'xml') AS failures,
  round(count(*) FILTER (sourcetype = 'xml') / count(*), 4) AS rate FROM s GROUP BY start_ts""")
def win_format_failures(spark, folder):
    """Lines that match none of the line formats."""
    events = rendered(spark, folder).select("ts", detect_line_format(F.col("raw")).alias("fmt"))
    return _window_rows(SW.failure_rate(events, F.col("fmt") == "sample_log"))


_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS events
FROM s GROUP BY user_id, n"""


@query("win_sessions", _SESSIONS)
def win_sessions(spark, folder):
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _ntz(SW.flat_window(SW.sessions(events, ["user_id"])), "start_ts", "end_ts")


# --- Streams ------------------------------------------------------------------------------------

@query("stream_onboard", f"SELECT {_KV_COLUMNS} FROM ({EV})")
def stream_onboard(spark, folder):
    events = R.with_typed_values(SO.stream_table(spark, folder, "events"))
    lines = events.select("event_id", R.kv_line().alias("raw"))
    return _ntz(SO.run_to_table(spark, A.apply(lines, KV_SPEC), "onboard"), "event_time")


@query("stream_pii_rate", f"{_RATE} WHERE {_CLOSED.format('events')} GROUP BY ALL")
def stream_pii_rate(spark, folder):
    """Windows that the final watermark has closed."""
    events = SW.with_event_time(SO.stream_table(spark, folder, "events"))
    rates = SW.flat_window(SW.rate_per_window(_pii_per_event(events), ["type"]))
    return _ntz(SO.run_to_table(spark, rates, "rate").drop("end_ts"), "start_ts")


@query("stream_failure_rate", """
WITH s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS start_ts, event_type
  FROM events, (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT start_ts, count(*) AS events, count(*) FILTER (event_type = 'error') AS failures,
  round(count(*) FILTER (event_type = 'error') / count(*), 4) AS rate FROM s
WHERE start_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY start_ts""")
def stream_failure_rate(spark, folder):
    """The sliding rate as a stream: windows that the final watermark has closed."""
    events = SW.with_event_time(SO.stream_table(spark, folder, "events"))
    rates = SW.flat_window(SW.failure_rate(events, F.col("event_type") == "error")).drop("end_ts")
    return _ntz(SO.run_to_table(spark, rates, "failures"), "start_ts")


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, folder):
    """Every event arrives twice."""
    events = SW.with_event_time(SO.stream_table(spark, folder, "events"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return SO.run_to_table(
        spark, SW.drop_duplicates(twice, ["event_id"]).select("event_id", "user_id"), "dedup")


@query("stream_sessions", f"""
SELECT * FROM ({_SESSIONS}) WHERE end_ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(spark, folder):
    events = SW.with_event_time(SO.stream_table(spark, folder, "events").select("user_id", "ts"))
    done = SO.run_to_table(spark, SW.flat_window(SW.sessions(events, ["user_id"])), "sessions")
    return _ntz(done, "start_ts", "end_ts")


@query("stream_drift", f"""
SELECT DISTINCT event_type AS sourcetype, unnest(['k'||k, 'login']) AS name FROM ({EV})""")
def stream_drift(spark, folder):
    """Field names that a stream shows for the first time."""
    events = R.with_typed_values(SO.stream_table(spark, folder, "events"))
    line = R.text("k", F.col("k"), "=1 login=", F.col("login"))
    names = each(events, [F.col("event_type").alias("sourcetype"), "ts"], X.kv_pairs(line), "p").select(
        "sourcetype", "ts", F.col("p.name").alias("name"))
    return SO.run_to_table(spark, SW.first_seen(names), "drift")


@query("stream_redact", f"""
SELECT doc_id, regexp_replace(regexp_replace(text, {O.lit(P.REDACTION_PATTERNS['EmailDetector'])}, '[REDACTED_EMAIL]', 'g'),
  {O.lit(P.REDACTION_PATTERNS['IpAddressDetector'])}, '[REDACTED_IP_ADDRESS]', 'g') AS redacted FROM documents""")
def stream_redact(spark, folder):
    """Documents masked before they are stored."""
    docs = SO.stream_table(spark, folder, "documents").select("doc_id", redaction.redact_patterns(
        F.col("text"), redaction.detector_rules(["EmailDetector", "IpAddressDetector"])).alias("redacted"))
    return SO.run_to_table(spark, docs, "redact")


