"""Turn samples into specifications: the profiling job.

All work is aggregation per sourcetype and field name. What comes back to the driver is one row per
sourcetype and field; a sourcetype with more names than a schema can have is reported, not profiled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from logsluice.functions import extract as X
from logsluice.functions import patterns as P
from logsluice.functions.literals import lookup
from logsluice.functions.rows import each
from logsluice.functions.timeparse import detect_time_format, time_prefix
from logsluice.operators import mapping
from logsluice.operators.fields import json_text_pairs
from logsluice.operators.formats import csv_sourcetypes, format_without_csv
from logsluice.operators.rules import Extraction
from logsluice.plans.spec import OnboardingSpec, TimeSettings

# More names than this in one sourcetype are data (ids in names), not a schema.
MAX_FIELDS = 2_000

_PATTERNS = {
    "apache": (P.APACHE_ACCESS, P.APACHE_ACCESS_NAMES),
    "syslog": (P.SYSLOG_STANDARD, P.SYSLOG_STANDARD_NAMES),
    "syslog_3164": (P.SYSLOG_3164, P.SYSLOG_3164_NAMES),
    "syslog_5424": (P.SYSLOG_5424, P.SYSLOG_5424_NAMES),
}
# Where the time stands in formats that fix its place.
_FORMAT_TIME = {
    "apache": TimeSettings("%d/%b/%Y:%H:%M:%S %z", r"\[", 29),
    "syslog": TimeSettings("%b %d %H:%M:%S", "^", 16),
    "syslog_3164": TimeSettings("%b %d %H:%M:%S", r"^<\d+>", 16),
    "syslog_5424": TimeSettings("%Y-%m-%dT%H:%M:%S", r"^<\d+>\d+\s+", 40),
}
_HEADER_CELL = re.compile(r"[A-Za-z_][\w .@-]*")


def line_shapes(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``fmt``, ``time_format`` and ``prefix`` of every line; CSV is decided per sourcetype."""
    line = F.col(raw)
    tables = csv_sourcetypes(df, raw).select(
        F.col("sourcetype").alias("_csv"), F.col("seps").alias("_seps"))
    shaped = df.withColumn("_fmt", format_without_csv(line)).join(
        tables, F.col("sourcetype").eqNullSafe(F.col("_csv")) & (F.col("_fmt") == "kv"), "left")
    fmt = F.when(F.col("_seps").isNotNull(), "csv").otherwise(F.col("_fmt"))
    shaped = shaped.withColumn("fmt", fmt).withColumn("time_format", detect_time_format(line, slash_first=True))
    up_to = lookup(F.col("time_format"), {name: rf"\A([\s\S]*?)(?:{p})" for p, name in P.TIME_FORMATS_SLASH_FIRST})
    prefix = F.when(up_to.isNotNull(), time_prefix(F.call_function("regexp_extract", line, up_to, F.lit(1)), F.col("fmt"))).otherwise("")
    return shaped.withColumn("prefix", prefix).drop("_csv", "_fmt")


def _names(shaped: DataFrame) -> DataFrame:
    """``(sourcetype, name, pos)`` of formats whose lines carry their names, pairs in a message included."""
    line = F.col("raw")
    message = F.coalesce(*[
        F.when(F.col("fmt") == f, X.empty_to_null(F.regexp_extract(line, p, len(n)))) for f, (p, n) in _PATTERNS.items()
        if n[-1] == "message"], F.lit(""))
    pairs = (
        F.when(F.col("fmt") == "json", json_text_pairs(line))
        .when(F.col("fmt") == "xml", X.xml_auto(line))
        .when(F.col("fmt") == "kv", X.kv_pairs(line))
        .when(F.col("fmt").startswith("syslog"), X.kv_dialects(message)))
    return each(shaped, ["sourcetype"], F.transform(pairs, lambda p: p["name"]), "name", "pos")


def crowded(df: DataFrame, max_fields: int = MAX_FIELDS) -> DataFrame:
    """Sourcetypes with more field names than a specification holds, and how many they have."""
    names = _names(line_shapes(df.select("event_id", "sourcetype", "raw"))).select("sourcetype", "name").distinct()
    return names.groupBy("sourcetype").agg(F.count("*").alias("names")).filter(F.col("names") > max_fields)


def profile(
    df: DataFrame, model: str | None = None, headers: dict[str, list[str]] | None = None,
    detectors: Sequence[str] = (), max_fields: int = MAX_FIELDS,
) -> list[OnboardingSpec]:
    """A specification per sourcetype, NULL included, from ``(event_id, sourcetype, raw)``.

    ``model`` adds the suggested mapping to that model; ``headers`` names CSV columns, else the first
    line does if it looks like a header, else they are ``column_<i>``. A sourcetype with more than
    ``max_fields`` names gets a specification without fields; :func:`crowded` lists such sourcetypes.
    """
    headers = headers or {}
    shaped = line_shapes(df.select("event_id", "sourcetype", "raw"))
    counts = shaped.groupBy("sourcetype", "fmt", "time_format", "prefix").agg(
        F.count("*").alias("n"), F.max("_seps").alias("seps"),
        F.min(F.when(F.col("fmt") == "csv", F.struct("event_id", "raw"))).alias("first"))
    # A format is settled by its lines; of its lines the most frequent time and place of it are taken.
    per_format = counts.groupBy("sourcetype", "fmt").agg(
        F.sum("n").alias("lines"), F.max("seps").alias("seps"), F.min("first")["raw"].alias("first"),
        F.min_by(F.struct("time_format", "prefix"), F.struct(
            (F.col("time_format") == P.CURRENT_TIME).alias("none"), -F.col("n"), "time_format", "prefix")).alias("time"))
    best = per_format.groupBy("sourcetype").agg(
        F.min_by(F.struct("fmt", "time", "seps", "first"), F.struct(-F.col("lines"), F.col("fmt"))).alias("s"))
    seen = mapping.field_names(_names(shaped))
    fitting = seen.groupBy(F.col("sourcetype").alias("_fits")).agg(F.count("*").alias("_names")).filter(
        F.col("_names") <= max_fields)
    rows = seen.join(fitting, F.col("sourcetype").eqNullSafe(F.col("_fits")), "left_semi").collect()
    fields: dict[str | None, list[tuple[int, str]]] = {}
    for r in rows:
        fields.setdefault(r["sourcetype"], []).append((r["pos"], r["name"]))
    specs = [
        _spec(r["sourcetype"], r["s"], [n for _, n in sorted(fields.get(r["sourcetype"], []))], headers, detectors)
        for r in sorted(best.collect(), key=lambda r: (r["sourcetype"] is not None, r["sourcetype"] or ""))]
    if model:
        specs = _with_mapping(df, specs, model)
    return specs


def _with_mapping(df: DataFrame, specs: list[OnboardingSpec], model: str) -> list[OnboardingSpec]:
    """The model's fields suggested for the names of each specification."""
    rows = [(i, n, p) for i, s in enumerate(specs) for p, n in enumerate(s.fields) if n]
    if not rows:
        return specs
    named = df.sparkSession.createDataFrame(
        [(str(i), n, p) for i, n, p in rows], "sourcetype string, name string, pos int")
    found: dict[int, list[tuple[str, str]]] = {}
    for r in mapping.auto_map(named, models={model: mapping.CIM_MODELS[model]}).collect():
        found.setdefault(int(r["sourcetype"]), []).append((r["name"], r["cim_field"]))
    return [replace(s, mapping=sorted(found.get(i, []))) for i, s in enumerate(specs)]


def _columns(sourcetype: str | None, shape, headers: dict[str, list[str]]) -> list[str]:
    if sourcetype in headers:
        return headers[sourcetype]
    cells = [c.strip().strip('"') for c in (shape["first"] or "").split(",")]
    if len(cells) == shape["seps"] + 1 == len(set(cells)) and all(_HEADER_CELL.fullmatch(c) for c in cells):
        return cells
    return [f"column_{i + 1}" for i in range(shape["seps"] + 1)]


def _spec(sourcetype, shape, names, headers, detectors) -> OnboardingSpec:
    fmt, found = shape["fmt"], shape["time"]
    time = _FORMAT_TIME.get(fmt)
    if time is None:
        time = TimeSettings() if found["time_format"] == P.CURRENT_TIME else TimeSettings(
            found["time_format"], found["prefix"], 40 if found["prefix"] not in ("", "^") else P.WHOLE_LINE)
    common = dict(sourcetype=sourcetype, time=time, detectors=tuple(detectors))
    if fmt in _PATTERNS:
        pattern, groups = _PATTERNS[fmt]
        # Pairs inside a syslog message follow the fields of the header.
        return OnboardingSpec(
            kind="pattern", fields=[*groups, *(n for n in names if n not in groups)],
            extraction=Extraction(pattern, tuple(groups)), **common)
    if fmt == "csv":
        return OnboardingSpec(kind="csv", fields=_columns(sourcetype, shape, headers), **common)
    return OnboardingSpec(kind={"json": "json", "xml": "xml"}.get(fmt, "kv"), fields=names, **common)
