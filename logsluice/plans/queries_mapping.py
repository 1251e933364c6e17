"""Queries that map fields to models and handle stored suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.operators import mapping, suggestions
from logsluice.plans import oracle_text as O
from logsluice.plans.queries_fields import TYPED_FIELDS, records
from logsluice.plans.registry import query
from logsluice.sources import rendered as R
from logsluice.sources.dimensions import CIM_MODELS, cim_fields, model_rows, synonym_rows, values_sql
from logsluice.sources.tables import table

EV = O.EVENTS

# Names that occur, from the sourcetypes that occur.
_NAMES = f"""SELECT n.* FROM {values_sql(
    [(s, n, i) for s, names in TYPED_FIELDS.items() for i, n in enumerate(names)], 'sourcetype, name, pos')
    .replace(' AS t(', ' AS n(')} WHERE sourcetype IN (SELECT sourcetype FROM ({EV}))"""
_SYNONYMS = f"SELECT * FROM {values_sql(synonym_rows(CIM_MODELS), 'cim_field, pattern')}"
_MODELS = f"SELECT * FROM {values_sql(model_rows(), 'model, cim_field, fpos')}"
_AUTO = f"""
SELECT sourcetype, model, cim_field, arg_min(name, pos) AS name FROM (
  SELECT n.sourcetype, n.name, n.pos, s.cim_field FROM ({_NAMES}) n JOIN ({_SYNONYMS}) s
    ON contains(lower(n.name), s.pattern) OR contains(s.pattern, lower(n.name))) JOIN ({_MODELS}) m USING (cim_field)
GROUP BY sourcetype, model, cim_field"""
_COMPLIANCE = f"""
WITH g AS (SELECT sourcetype, model, total FROM (SELECT DISTINCT sourcetype FROM ({EV})),
  (SELECT model, count(*) AS total FROM ({_MODELS}) GROUP BY model)),
q AS (SELECT g.sourcetype, g.model, CAST(total AS INTEGER) AS total, count(DISTINCT a.cim_field) AS mapped
  FROM g LEFT JOIN ({_AUTO}) a ON a.sourcetype = g.sourcetype AND a.model = g.model GROUP BY ALL)
SELECT *, CAST(floor(100.0 * mapped / total + 0.5) AS INTEGER) AS quality FROM q"""
_LABEL = """CASE WHEN quality >= 90 THEN 'Excellent' WHEN quality >= 80 THEN 'Good' WHEN quality >= 60 THEN 'Fair'
  WHEN quality >= 40 THEN 'Poor' ELSE 'Critical' END"""


def _names(spark, folder):
    return mapping.field_names(records(spark, folder))


@query("cim_auto_map", _AUTO)
def cim_auto_map(spark, folder):
    return mapping.auto_map(_names(spark, folder))


_SCORE = """CASE WHEN lower(name) = pattern THEN 1.0 WHEN contains(lower(name), pattern) OR contains(pattern, lower(name))
  THEN 0.8 ELSE round(1.0 - levenshtein(lower(name), pattern)::DOUBLE / greatest(length(name), length(pattern)), 4) END"""
_FUZZY = f"""
SELECT sourcetype, cim_field, max(score) AS score, arg_min(name, (-score, pos, name)) AS name FROM (
  SELECT sourcetype, name, pos, cim_field, CAST({_SCORE} AS DOUBLE) AS score FROM ({_NAMES}), ({_SYNONYMS}))
WHERE score >= 0.6 GROUP BY sourcetype, cim_field"""


@query("cim_fuzzy_map", _FUZZY)
def cim_fuzzy_map(spark, folder):
    return mapping.fuzzy_map(_names(spark, folder))


@query("cim_fuzzy_one_to_one", f"""
SELECT sourcetype, name, arg_min(cim_field, (-score, cim_field)) AS cim_field, max(score) AS score
FROM ({_FUZZY}) GROUP BY sourcetype, name""")
def cim_fuzzy_one_to_one(spark, folder):
    return mapping.one_to_one(mapping.fuzzy_map(_names(spark, folder)))


@query("cim_compliance", f"SELECT *, {_LABEL} AS label FROM ({_COMPLIANCE})")
def cim_compliance(spark, folder):
    return mapping.compliance(_names(spark, folder))


@query("cim_best_model", f"""
SELECT sourcetype, model, quality, {_LABEL} AS label FROM (
  SELECT sourcetype, arg_min(model, (-quality, model)) AS model, max(quality) AS quality FROM ({_COMPLIANCE}) GROUP BY 1)""")
def cim_best_model(spark, folder):
    return mapping.best_model(mapping.compliance(_names(spark, folder)))


@query("cim_quality", f"""
SELECT sourcetype, quality, {_LABEL} AS label FROM ({_COMPLIANCE}) WHERE model = 'web'""")
def cim_quality(spark, folder):
    return mapping.compliance(_names(spark, folder), models={"web": CIM_MODELS["web"]}).select(
        "sourcetype", "quality", "label")


_ALIASES = [("login", "user"), ("ip", "src_ip"), ("event_type", "action"), ("k", "k"), ("host", ""), ("gone", "x")]


@query("cim_alias", f"""
SELECT event_id, login, ip, event_type, k, host, login AS user, ip AS src_ip, event_type AS action FROM ({EV})""")
def cim_alias(spark, folder):
    events = R.typed_events(spark, folder).select("event_id", "login", "ip", "event_type", "k", "host")
    return mapping.alias_fields(events, _ALIASES)


@query("cim_rename", f"""
SELECT event_id, login AS user, ip AS src_ip, event_type AS action, k, host FROM ({EV})""")
def cim_rename(spark, folder):
    events = R.typed_events(spark, folder).select("event_id", "login", "ip", "event_type", "k", "host")
    return mapping.rename_fields(events, _ALIASES)


# --- Stored suggestions -------------------------------------------------------------------------

def _extraction_responses(spark, folder):
    """One response per part, in the shapes that services return."""
    turn, key = F.col("p_partkey") % 4, F.col("p_partkey")
    plain = R.text(
        '{"sourcetype":"st', key, '","fields":[{"name":"a","regex":"(?P<a>x)"},{"name":" ","regex":"(?<b_c>y)"},'
        '{"regex":"z"}],"combined_regex":"c', key, '","time_format":"%Y","time_prefix":"^","max_timestamp_lookahead":"',
        key % 40, '"}')
    other = R.text(
        '{"field_extractions":[{"field":"f', key, '","regex":"r"},{"regex":"s"}],"combined_extraction":"d',
        key, '","timestamp_analysis":{"TIME_FORMAT":"%H","TIME_PREFIX":"p","MAX_TIMESTAMP_LOOKAHEAD":30}}')
    empty = R.text('{"sourcetype":"e', key, '"}')
    content = F.when(turn == 0, plain).when(turn == 1, other).when(turn == 2, empty).otherwise("not json")
    return table(spark, folder, "part").select("p_partkey", content.alias("content"))


@query("suggest_normalize", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'st'||p_partkey WHEN 2 THEN 'e'||p_partkey ELSE 'custom_log' END AS sourcetype,
  CASE p_partkey % 4 WHEN 0 THEN 'a,b_c,field_3' WHEN 1 THEN 'f'||p_partkey||',unknown' ELSE '' END AS names,
  CASE p_partkey % 4 WHEN 0 THEN 'c'||p_partkey WHEN 1 THEN 'd'||p_partkey END AS combined_regex,
  CASE p_partkey % 4 WHEN 0 THEN '%Y' WHEN 1 THEN '%H' ELSE 'CURRENT_TIME' END AS time_format,
  CASE p_partkey % 4 WHEN 0 THEN '^' WHEN 1 THEN 'p' ELSE '' END AS time_prefix,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 40 AS VARCHAR) WHEN 1 THEN '30' ELSE '25' END AS max_timestamp_lookahead,
  CASE WHEN p_partkey % 4 = 3 THEN 'Failed to parse response' END AS error FROM part""")
def suggest_normalize(spark, folder):
    done = suggestions.normalize_extraction(_extraction_responses(spark, folder), "content")
    return done.select(
        "p_partkey", "sourcetype", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("names"),
        "combined_regex", "time_format", "time_prefix", "max_timestamp_lookahead", "error")


@query("fields_named", """
SELECT p_partkey, i AS pos, CASE i WHEN 1 THEN 'n'||p_partkey WHEN 2 THEN 'g'||(p_partkey % 9) ELSE 'field_3' END AS name
FROM part, (SELECT unnest([1, 2, 3]) AS i)""")
def fields_named(spark, folder):
    key = F.col("p_partkey")
    listed = F.array(
        F.struct(R.text("n", key).alias("name"), F.lit("x").alias("regex")),
        F.struct(F.lit("  ").alias("name"), R.text("(?P<g", key % 9, ">x)").alias("regex")),
        F.struct(F.lit(None).cast("string").alias("name"), F.lit("(x)").alias("regex")))
    return table(spark, folder, "part").select(
        "p_partkey", F.posexplode(suggestions.name_fields(listed)).alias("i", "f")).select(
        "p_partkey", (F.col("i") + 1).alias("pos"), F.col("f.name").alias("name"))


def _mapping_responses(spark, folder):
    """Per supplier an array, a wrapped array, or text that is no mapping."""
    key = F.col("s_suppkey")
    items = R.text(
        '[{"field":"login","cimField":"user","confidence":0.9,"reasoning":"s', key, '"},'
        '{"field":"ghost","cimField":"user","confidence":0.5,"reasoning":"g"},'
        '{"field":"ip","cimField":"nowhere","confidence":0.4,"reasoning":"n"}]')
    content = F.when(key % 4 == 0, items).when(key % 4 == 1, R.text('{"suggestions":', items, "}")).when(
        key % 4 == 2, R.text('{"a":', items, ',"b":1}')).otherwise("[oops")
    return table(spark, folder, "supplier").select("s_suppkey", content.alias("content"))


_ITEMS = """
SELECT s_suppkey, 'login' AS field, 'user' AS "cimField", 0.9::DOUBLE AS confidence, 's'||s_suppkey AS reasoning
FROM supplier WHERE s_suppkey % 4 < 2
UNION ALL SELECT s_suppkey, 'ghost', 'user', 0.5, 'g' FROM supplier WHERE s_suppkey % 4 < 2
UNION ALL SELECT s_suppkey, 'ip', 'nowhere', 0.4, 'n' FROM supplier WHERE s_suppkey % 4 < 2"""


def _items(spark, folder):
    parsed = suggestions.mapping_items(_mapping_responses(spark, folder), "content")
    return suggestions.explode_items(parsed, ["s_suppkey"])


def _known(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey", F.explode(F.array(F.lit("login"), F.lit("ip"))).alias("name"))


def _auth_fields(spark):
    return cim_fields(spark).filter((F.col("variant") == "server") & (F.col("model") == "authentication"))


@query("suggest_mapping", f"""
SELECT s_suppkey, field, "cimField", confidence, reasoning, NULL::VARCHAR AS error FROM ({_ITEMS})
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, 'Failed to parse response' FROM supplier WHERE s_suppkey % 4 >= 2""")
def suggest_mapping(spark, folder):
    parsed = suggestions.mapping_items(_mapping_responses(spark, folder), "content")
    return parsed.select("s_suppkey", "error", F.inline_outer("items"))


@query("suggest_valid", f"""SELECT * FROM ({_ITEMS}) WHERE field = 'login'""")
def cim_suggest_valid_rows(spark, folder):
    return suggestions.valid_items(
        _items(spark, folder), _known(spark, folder), _auth_fields(spark), "s_suppkey")


@query("cim_suggest_valid", f"""
SELECT field, "cimField", count(*) AS items FROM ({_ITEMS}) WHERE field = 'login' GROUP BY ALL""")
def cim_suggest_valid(spark, folder):
    return cim_suggest_valid_rows(spark, folder).groupBy("field", "cimField").agg(F.count("*").alias("items"))


@query("cim_suggest_rejected", f"""
SELECT s_suppkey, field, "cimField", CASE field WHEN 'ghost' THEN 'unknown field' ELSE 'unknown model field' END AS reason
FROM ({_ITEMS}) WHERE field <> 'login'""")
def cim_suggest_rejected(spark, folder):
    return suggestions.rejected_items(
        _items(spark, folder), _known(spark, folder), _auth_fields(spark), "s_suppkey",
    ).select("s_suppkey", "field", "cimField", "reason")
