"""The field catalogue: records per event, profiles, order, upsert, drift."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from logsluice.functions import extract as X
from logsluice.functions import patterns as P
from logsluice.functions.literals import text_array
from logsluice.functions.rows import bind, each, first_flags
from logsluice.functions.typing import infer_field_type, infer_json_type, pii_flag
from logsluice.operators.formats import detect_format
from logsluice.sources.catalog import existing_columns

AUTO, CUSTOM, SUGGESTED, EXISTING = "auto_detect", "custom_regex", "suggested", "existing"
_PAIRS = "array<struct<name:string,value:string>>"


def _zip_names(values: Column, names: Sequence[str]) -> Column:
    named = F.zip_with(
        text_array(names), values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    # An unset group is empty; names without a value at all are NULL.
    return F.filter(named, lambda p: p["value"] != "")


def _apache_pairs(raw: Column) -> Column:
    names = P.APACHE_COMMON_NAMES
    request = names.index("request")
    none = F.array().cast("array<string>")

    def pairs(groups: Column) -> Column:
        parts = F.split(F.get(groups, request), " ")
        extra = F.when(F.size(parts) >= 3, F.slice(parts, 1, 3)).otherwise(none)
        return F.concat(
            _zip_names(groups, names), _zip_names(extra, ["method", "uri", "protocol"]))

    return bind(X.group_values(raw, P.APACHE_COMMON, len(names)), pairs)


def _syslog_pairs(raw: Column) -> Column:
    """Header fields of the variant that matches, then the pairs inside the message."""
    def header(pattern: str, names: list[str]) -> Column:
        return _zip_names(X.group_values(raw, pattern, len(names)), names)

    fields = (
        F.when(raw.rlike(P.SYSLOG_STANDARD), header(P.SYSLOG_STANDARD, P.SYSLOG_STANDARD_NAMES))
        .when(raw.rlike(P.SYSLOG_3164), header(P.SYSLOG_3164, P.SYSLOG_3164_NAMES))
        .otherwise(header(P.SYSLOG_5424, P.SYSLOG_5424_NAMES)))
    return bind(fields, lambda pairs: F.concat(
        pairs, X.kv_dialects(F.coalesce(X.pair_value(pairs, "message"), F.lit("")))))


def json_text_pairs(raw: Column) -> Column:
    return F.transform(X.json_pairs(raw), lambda p: F.struct(
        p["name"].alias("name"), X.variant_text(p["value"]).alias("value")))


def _csv_pairs(raw: Column, header: Sequence[str], sep: str) -> Column:
    schema = ", ".join(f"`c{i}` string" for i in range(len(header)))
    row = F.from_csv(raw, schema, {"sep": sep, "quote": '"', "escape": '"'})
    return bind(row, lambda r: F.array(*[
        F.struct(F.lit(n).alias("name"), F.coalesce(r[f"c{i}"], F.lit("")).alias("value"))
        for i, n in enumerate(header)]))


def extract_auto(
    df: DataFrame, raw: str = "raw", header: Sequence[str] = (), sep: str = ",",
) -> DataFrame:
    """Add the detected format and the field pairs of each line.

    ``header`` names the columns of CSV lines. Without it a CSV line yields no fields.
    """
    line = F.col(raw)
    csv = _csv_pairs(line, header, sep) if header else F.array().cast(_PAIRS)
    pairs = (
        F.when(F.col("fmt") == "json", json_text_pairs(line))
        .when(F.col("fmt") == "csv", csv)
        .when(F.col("fmt") == "apache", _apache_pairs(line))
        .when(F.col("fmt") == "syslog", _syslog_pairs(line))
        .when(F.col("fmt") == "xml", X.xml_auto(line))
        .otherwise(X.kv_pairs(line)))
    return df.withColumn("fmt", detect_format(line)).withColumn("pairs", pairs)


def field_records(
    df: DataFrame, keys: Sequence[str], pairs: str = "pairs", source: str = AUTO,
    confidence: Column | float = 0.8, from_regex: bool = False,
) -> DataFrame:
    """One row per event and field with type, confidence and personal-data flag."""
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    rows = each(df, [*keys, conf.alias("confidence")], pairs, "p", "pos")
    return rows.select(
        *keys, "pos", F.col("p.name").alias("name"), F.col("p.value").alias("value"),
        infer_field_type(F.col("p.value")).alias("type"), "confidence",
        pii_flag(F.col("p.name"), F.col("p.value")).alias("is_pii"),
        F.lit(source).alias("source"), F.lit(from_regex).alias("from_regex"))


def format_confidence(fmt: Column) -> Column:
    chain = None
    for name in ("json", "apache", "csv", "syslog", "xml"):
        chain = F.when(fmt == name, P.CONFIDENCE[name]) if chain is None else chain.when(
            fmt == name, P.CONFIDENCE[name])
    return chain.otherwise(P.CONFIDENCE["kv"])


def json_field_records(df: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """Top-level JSON fields whose own kind (number, boolean) decides the type."""
    rows = each(df, keys, X.json_pairs(F.col(raw)), "p", "pos")
    text = X.variant_text(F.col("p.value"))
    return rows.select(
        *keys, "pos", F.col("p.name").alias("name"), text.alias("value"),
        infer_json_type(F.col("p.value")).alias("type"),
        F.lit(P.CONFIDENCE["json"]).alias("confidence"),
        pii_flag(F.col("p.name"), text).alias("is_pii"))


def flatten_json(df: DataFrame, keys: Sequence[str], raw: str, schema: str) -> DataFrame:
    """Struct leaves of nested JSON as dotted columns, also those of objects inside arrays.

    Arrays of a line are laid side by side: a line has as many rows as its longest array has elements, at
    least one, and shorter arrays are NULL behind their end. An array inside an array stays JSON text. The
    schema comes from a profile or the user, so a line is parsed once and only for its leaves.
    """
    if not schema.upper().startswith("STRUCT<") and ":" not in schema and " " not in schema.strip():
        return df.select(*keys)
    parsed = df.select(*keys, F.from_json(raw, schema).alias("_j"))
    leaves: list[tuple[Column, str]] = []
    arrays: list[tuple[Column, str, T.DataType]] = []

    def walk(kind: T.DataType, here: Column, name: str, inside: bool) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, here.getField(f.name), f"{name}.{f.name}" if name else f.name, inside)
        elif isinstance(kind, T.ArrayType) and not inside:
            arrays.append((here, name, kind.elementType))
        else:
            leaves.append((F.to_json(here) if isinstance(kind, T.ArrayType) else here, name))

    walk(parsed.schema["_j"].dataType, F.col("_j"), "", False)
    if arrays:
        none = F.array(F.lit(None))
        side = F.arrays_zip(*[
            F.when(F.size(a) > 0, a).otherwise(none.cast(T.ArrayType(kind))).alias(f"a{i}")
            for i, (a, _, kind) in enumerate(arrays)])
        parsed = parsed.select(*keys, "_j", F.explode_outer(side).alias("_e"))
        for i, (_, name, kind) in enumerate(arrays):
            walk(kind, F.col(f"_e.a{i}"), name, True)
    return parsed.select(*keys, *[c.alias(n) for c, n in leaves])


# In a schema's text a name stands in front of a colon, or in backticks; other words are types.
_SCHEMA_WORD = re.compile(r"`(?:[^`]|``)*`|\w+(?=\s*:)|\bOBJECT(?=<)|\bVOID\b")
_SCHEMA_TYPES = {"OBJECT": "STRUCT", "VOID": "STRING"}
MAX_JSON_KEYS = 10_000


def nested_json_schema(df: DataFrame, raw: str, max_keys: int = MAX_JSON_KEYS) -> str:
    """One schema that covers every line: the schemas of the lines merge in a map-side aggregate.

    Without any JSON object it is empty. More than ``max_keys`` different top-level keys are data, not a
    schema, and raise before anything is merged.
    """
    keys = df.select(F.explode(F.json_object_keys(raw)).alias("k")).distinct().limit(max_keys + 1).count()
    if keys > max_keys:
        raise ValueError("more JSON keys than a schema can hold; read the lines as maps")
    if not keys:
        return "STRUCT<>"
    objects = F.when(F.json_object_keys(raw).isNotNull(), F.try_parse_json(raw))
    merged = df.select(F.schema_of_variant_agg(objects).alias("s")).first()["s"]

    def typed(word: re.Match) -> str:
        following = merged[word.end():].lstrip()[:1]
        return word[0] if following == ":" or word[0].startswith("`") else _SCHEMA_TYPES[word[0]]

    return _SCHEMA_WORD.sub(typed, merged)


# --- Existing fields ----------------------------------------------------------------------------

def existing_fields(df: DataFrame, by: str, order: str) -> DataFrame:
    """Fields a table already has, with a sample value from the first row of each group.

    Internal columns are left out; empty, zero and missing values show as N/A. One aggregate that combines
    on the map side keeps the first row of each group.
    """
    columns = existing_columns(
        [c for c in df.columns if c != by], P.SYSTEM_FIELD_PREFIXES, P.SYSTEM_FIELDS)
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    place = F.when(F.col(order).isNotNull(), F.struct(F.col(order).alias("at"), row.alias("row")))
    first = df.groupBy(by).agg(F.min(place)["row"].alias("r"))
    falsy = lambda v: v.isNull() | v.isin("", "0", "0.0", "false")
    pairs = F.array(*[
        F.struct(F.lit(c).alias("name"),
                 F.when(falsy(F.col(f"r.`{c}`")), "N/A").otherwise(F.col(f"r.`{c}`")).alias("value"))
        for c in columns])
    rows = first.select(by, F.inline(pairs))
    return rows.select(
        by, "name", infer_field_type(F.col("value")).alias("type"), "value",
        F.lit(P.CONFIDENCE["existing"]).alias("confidence"), F.lit(EXISTING).alias("source"))


def sample_values(
    df: DataFrame, by: str, order: str, text: str, patterns: dict[str, str],
) -> DataFrame:
    """Per group, the first value that each field pattern yields, by ``order``; one column a field.

    Values are narrow, and the text itself does not reach the aggregate.
    """
    values = df.select(by, order, *[
        X.preview_value(F.col(text), p, n).alias(n) for n, p in patterns.items()])
    return values.groupBy(by).agg(*[
        F.min_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in patterns])


# --- Sets of records ----------------------------------------------------------------------------

def upsert_source(catalogue: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Replace the records of one source by new ones."""
    return catalogue.filter(F.col("source") != source).unionByName(fresh)


def new_only(catalogue: DataFrame) -> DataFrame:
    """Records that need an extraction, because the data does not have the field yet."""
    return catalogue.filter(F.col("source") != EXISTING)


def absent_by_name(candidates: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Candidates whose name is not present yet."""
    return candidates.join(present.select(*on).distinct(), list(on), "left_anti")


def longest_values(records: DataFrame, by: str = "name") -> DataFrame:
    """Distinct values worth marking (longer than two characters, known), longest first."""
    return records.filter((F.col("value") != "N/A") & (F.length("value") > 2)).select(
        by, "value").distinct().orderBy(F.length("value").desc(), "value", by)


# --- Profiles -----------------------------------------------------------------------------------

def profile(records: DataFrame, lines: DataFrame, by: str = "sourcetype", key: str = "event_id") -> DataFrame:
    """Per field: fill rate, distinct values, length range, most frequent value.

    Values are counted first; the second aggregate sees one row per value and combines on the map
    side, so a frequent field or value does not gather in one task.
    """
    values = records.groupBy(by, "name", "value").agg(
        F.count("*").alias("n"), F.count_if(F.col("first_in_event")).alias("events"))
    per_field = values.groupBy(by, "name").agg(
        F.sum("n").alias("items"), F.sum("events").alias("events"),
        F.count("*").alias("distinct_values"),
        F.min(F.length("value")).cast("bigint").alias("min_length"),
        F.max(F.length("value")).cast("bigint").alias("max_length"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"))
    totals = lines.groupBy(by).agg(F.count("*").alias("lines"))
    return per_field.join(totals, by).withColumn(
        "fill_rate", F.round(F.col("events") / F.col("lines"), 4))


def mark_first_in_event(pairs: Column) -> Column:
    """Pairs with a flag on the first occurrence of a name, to count events and not matches."""
    def marked(every: Column) -> Column:
        return F.transform(first_flags(F.transform(every, lambda p: p["name"])), lambda f: F.struct(
            F.get(every, f["place"])["name"].alias("name"), F.get(every, f["place"])["value"].alias("value"),
            f["first"].alias("first")))

    return bind(pairs, marked)


def type_profile(records: DataFrame, by: str = "sourcetype") -> DataFrame:
    """Type of a field over all its values: the only type, float for integer with float, else
    string; and the share of the most frequent type."""
    counts = records.groupBy(by, "name", "type").agg(F.count("*").alias("n"))
    types = F.count("*")
    numeric = F.count_if(F.col("type").isin("integer", "float", "number"))
    return counts.groupBy(by, "name").agg(
        F.sum("n").alias("items"), types.alias("types"),
        F.when(types == 1, F.min("type")).when(types == numeric, "float").otherwise("string").alias("type"),
        F.round(F.max("n") / F.sum("n"), 4).alias("top_share"))


def ordered_fields(raw: Column, names: Sequence[str]) -> Column:
    """Field names in the order of their ``name=`` in the line; absent ones are left out."""
    found = F.array(*[
        F.struct(F.regexp_instr(raw, F.lit(rf"(?i)\b{n}=[^\s]+")).alias("pos"), F.lit(n).alias("name"))
        for n in names])
    return F.transform(
        F.array_sort(F.filter(found, lambda f: f["pos"] > 0)), lambda f: f["name"])


def first_seen(records: DataFrame, by: str = "sourcetype", ts: str = "ts") -> DataFrame:
    """When each field name first occurred in a sourcetype."""
    return records.groupBy(by, "name").agg(F.min(ts).alias("first_ts"))


def drift(records: DataFrame, by: str = "sourcetype", ts: str = "ts", unit: str = "hour") -> DataFrame:
    """New field names per sourcetype and hour, with the hour before that also brought some.

    The window runs over hours with news, which are few, not over records.
    """
    hours = first_seen(records, by, ts).groupBy(
        by, F.date_trunc(unit, "first_ts").alias("hour")).agg(F.count("*").alias("new_fields"))
    order = Window.partitionBy(by).orderBy("hour")
    return hours.withColumn("previous_hour", F.lag("hour").over(order))
