"""Queries over sources, samples, catalogues and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice import scratch_dir
from logsluice.functions import patterns as P
from logsluice.operators import fields, formats, mapping
from logsluice.plans import oracle_text as O
from logsluice.plans.registry import query
from logsluice.sources import catalog, lines
from logsluice.sources.dimensions import CIM_MODELS, model_rows, values_sql
from logsluice.sources.rendered import kv_line, rendered_events, text, typed_events
from logsluice.sources.tables import table

EV = O.EVENTS


@query("src_lines", f"""
SELECT event_id, login, val, 'kv' AS sourcetype, 'file' AS kind FROM ({EV})""")
def src_lines(spark, folder):
    """Lines written as text files and read back."""
    path = scratch_dir(spark, "lines")
    rendered = typed_events(spark, folder).select(text("id=", F.col("event_id"), " ", kv_line()))
    rendered.write.text(path)
    back = lines.read_lines(spark, path, "kv")
    pick = lambda p: F.regexp_extract("raw", p, 1)
    return back.select(
        pick(r"^id=(\d+)").cast("bigint").alias("event_id"), pick(r"user=(\S+)").alias("login"),
        pick(r"value=(\S+)").alias("val"), "sourcetype",
        catalog.provenance(F.col("source"))["kind"].alias("kind"))


@query("src_delimited", """
SELECT o_orderkey AS id, o_orderstatus AS status, 'the "' || o_orderpriority || '"; big' AS note FROM orders""")
def src_delimited(spark, folder):
    """A semicolon separated file with a header, quotes and doubled quotes."""
    path = scratch_dir(spark, "delimited")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        text('the "', F.col("o_orderpriority"), '"; big').alias("note"))
    orders.write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(path)
    return lines.read_delimited(spark, path, "id long, status string, note string", sep=";")


@query("sink_partitioned", f"""
SELECT sourcetype, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM ({EV}) GROUP BY sourcetype""")
def sink_partitioned(spark, folder):
    """Write by sourcetype and read one answer back from the partitions."""
    path = scratch_dir(spark, "sink")
    lines.write_events(rendered_events(spark, folder).select("event_id", "sourcetype", "raw"), path)
    return spark.read.parquet(path).groupBy("sourcetype").agg(
        F.count("*").alias("events"), F.sum("event_id").alias("id_sum"))


@query("src_sample_latest", f"""
SELECT event_id, ip, login FROM ({EV}) WHERE index_name = 'click' AND sourcetype = 'apache'
  AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 5""")
def src_sample_latest(spark, folder):
    return catalog.latest_sample(
        rendered_events(spark, folder), "click", "apache", "2024-01-10", "2024-01-20", 5,
    ).select("event_id", "ip", "login")


@query("src_sample_per_type", f"""
SELECT sourcetype, event_id, rank FROM (SELECT sourcetype, event_id,
  row_number() OVER (PARTITION BY sourcetype ORDER BY ts DESC, event_id) AS rank FROM ({EV})) WHERE rank <= 3""")
def src_sample_per_type(spark, folder):
    return catalog.sample_per_sourcetype(rendered_events(spark, folder), 3).select(
        "sourcetype", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("src_catalog", f"SELECT DISTINCT index_name FROM ({EV})")
def src_catalog(spark, folder):
    return catalog.indexes(rendered_events(spark, folder))


@query("src_sourcetypes", f"""
SELECT sourcetype, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM ({EV})
WHERE index_name = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1""")
def src_sourcetypes(spark, folder):
    found = catalog.sourcetypes(rendered_events(spark, folder), "error", "2024-01-05", "2024-01-25")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("src_provenance", """
SELECT event_id, kind, name, index_name, sourcetype FROM (SELECT event_id,
  CASE event_id % 3 WHEN 0 THEN 'paste' WHEN 1 THEN 'file' ELSE 'store' END AS kind,
  CASE event_id % 3 WHEN 1 THEN event_type || '.log' END AS name,
  CASE event_id % 3 WHEN 2 THEN 'main' END AS index_name,
  CASE event_id % 3 WHEN 2 THEN event_type END AS sourcetype FROM events)""")
def src_provenance(spark, folder):
    turn = F.col("event_id") % 3
    tag = F.when(turn == 0, "paste").when(turn == 1, text("file:", F.col("event_type"), ".log")).otherwise(
        text("store:main:", F.col("event_type")))
    tagged = table(spark, folder, "events").select("event_id", tag.alias("source"))
    return tagged.select("event_id", *[c.alias(n) for n, c in catalog.provenance(F.col("source")).items()])


@query("cim_catalog", f"""
WITH m AS (SELECT * FROM {values_sql(model_rows(), 'model, cim_field, pos')}),
n AS (SELECT DISTINCT event_type AS sourcetype, unnest(['action', 'user', 'src_ip', 'bytes']) AS name FROM events)
SELECT m.model, n.sourcetype, count(*) AS present FROM m JOIN n ON m.cim_field = n.name GROUP BY ALL""")
def cim_catalog(spark, folder):
    """How many fields of each model every event type already has under the model's own name."""
    from logsluice.sources.dimensions import cim_fields

    names = table(spark, folder, "events").select(
        F.col("event_type").alias("sourcetype")).distinct().select(
        "sourcetype", F.explode(F.array(*map(F.lit, ("action", "user", "src_ip", "bytes")))).alias("cim_field"))
    models = cim_fields(spark).filter(F.col("variant") == "ui")
    return names.join(F.broadcast(models), "cim_field").groupBy("model", "sourcetype").agg(
        F.count("*").alias("present"))


# --- Formats ------------------------------------------------------------------------------------

@query("fmt_detect_wizard", f"SELECT event_id, sourcetype AS fmt FROM ({EV})")
def fmt_detect_wizard(spark, folder):
    return rendered_events(spark, folder).select(
        "event_id", formats.detect_format(F.col("raw")).alias("fmt"))


@query("fmt_detect_single_line", f"""
SELECT event_id, CASE sourcetype WHEN 'csv' THEN 'kv' ELSE sourcetype END AS fmt FROM ({EV})""")
def fmt_detect_single_line(spark, folder):
    return rendered_events(spark, folder).select(
        "event_id", formats.detect_format(F.col("raw"), F.lit(False)).alias("fmt"))


_LINE_FORMATS = """CASE sourcetype WHEN 'apache' THEN 'apache_access' WHEN 'json' THEN 'json_log'
  WHEN 'csv' THEN 'csv_log' WHEN 'kv' THEN 'kv_log' WHEN 'syslog' THEN 'kv_log' ELSE 'sample_log' END"""


@query("fmt_detect_line", f"SELECT event_id, {_LINE_FORMATS} AS fmt FROM ({EV})")
def fmt_detect_line(spark, folder):
    return rendered_events(spark, folder).select(
        "event_id", formats.detect_line_format(F.col("raw")).alias("fmt"))


@query("fmt_by_sourcetype", f"""
WITH c AS (SELECT index_name AS sourcetype, {_LINE_FORMATS} AS fmt, count(*) AS n FROM ({EV}) GROUP BY ALL)
SELECT sourcetype, arg_min(fmt, (-n, fmt)) AS fmt, CAST(sum(n) AS BIGINT) AS lines,
  round(max(n) / sum(n), 4) AS share FROM c GROUP BY sourcetype""")
def fmt_by_sourcetype(spark, folder):
    lines_ = rendered_events(spark, folder).select(
        F.col("index_name").alias("sourcetype"), formats.detect_line_format(F.col("raw")).alias("fmt"))
    return formats.majority_format(lines_)


@query("fmt_resolve", f"""
SELECT event_id, CASE WHEN k % 3 = 0 THEN 'mine' WHEN k % 3 = 1 THEN event_type ELSE {_LINE_FORMATS} END AS sourcetype
FROM ({EV})""")
def fmt_resolve(spark, folder):
    override = F.when(F.col("k") % 3 == 0, "mine").otherwise("")
    actual = F.when(F.col("k") % 3 == 1, F.col("event_type"))
    return rendered_events(spark, folder).select("event_id", formats.resolve_sourcetype(
        override, actual, formats.detect_line_format(F.col("raw"))).alias("sourcetype"))


# --- Existing fields ----------------------------------------------------------------------------

@query("fields_existing", """
WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1),
u AS (
  SELECT event_type, 'event_id' AS name, CAST(event_id AS VARCHAR) AS value FROM f
  UNION ALL SELECT event_type, 'user_id', CAST(user_id AS VARCHAR) FROM f
  UNION ALL SELECT event_type, 'when', strftime(ts, '%Y-%m-%d') FROM f
  UNION ALL SELECT event_type, 'note', '' FROM f
  UNION ALL SELECT event_type, 'value', CAST(value AS VARCHAR) FROM f)
SELECT event_type, name, CASE WHEN value IN ('', '0', '0.0') THEN 'N/A' ELSE value END AS value,
  CASE WHEN name = 'when' THEN 'timestamp' WHEN value IN ('', '0', '0.0') THEN 'string'
    WHEN name = 'value' THEN 'float' ELSE 'integer' END AS type,
  1.0::DOUBLE AS confidence, 'existing' AS source FROM u""")
def fields_existing(spark, folder):
    """Internal columns do not show up among the fields."""
    events = table(spark, folder, "events").select(
        "event_type", "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("when"),
        F.lit("").alias("note"), "value", F.col("props").alias("_raw"),
        F.hour("ts").alias("date_hour"), F.lit("x").alias("punct"))
    return fields.existing_fields(events, "event_type", "event_id")


@query("cim_model_lookup", f"""
WITH m AS (SELECT model, count(*) AS n FROM {values_sql(model_rows(), 'model, cim_field, pos')} GROUP BY model),
e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'web' WHEN 'signup' THEN 'authentication'
  WHEN 'error' THEN 'application_state' WHEN 'view' THEN 'web' ELSE 'sales' END AS model FROM events)
SELECT e.event_id, e.model, m.n AS model_fields,
  CASE WHEN m.n IS NULL THEN 'Invalid CIM model specified: ' || e.model END AS error
FROM e LEFT JOIN m ON e.model = m.model""")
def cim_model_lookup(spark, folder):
    kind = F.col("event_type")
    model = F.when(kind == "click", "web").when(kind == "signup", "authentication").when(
        kind == "error", "application_state").when(kind == "view", "web").otherwise("sales")
    return mapping.lookup_model(
        spark, table(spark, folder, "events").select("event_id", model.alias("model")), "model")
