"""Stored responses of a suggestion service: normalising, validating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsluice.functions.patterns import CURRENT_TIME, DEFAULT_LOOKAHEAD
from logsluice.functions.rows import each

EXTRACTION_SCHEMA = """
sourcetype string, source string,
fields array<struct<name:string,regex:string>>,
field_extractions array<struct<field:string,regex:string>>,
combined_regex string, combined_extraction string,
time_format string, time_prefix string, max_timestamp_lookahead string,
timestamp_analysis struct<TIME_FORMAT:string,TIME_PREFIX:string,MAX_TIMESTAMP_LOOKAHEAD:string>
"""
MAPPING_ITEM = "struct<field:string,cimField:string,confidence:double,reasoning:string>"
_GROUP_NAME = r"\(\?P?<([a-zA-Z0-9_]+)>"
_FIELDS = "array<struct<name:string,regex:string>>"


def name_fields(fields: Column) -> Column:
    """Give every field a name: its own, else that of the first group, else ``field_<i>``."""
    return F.transform(fields, lambda f, i: F.struct(
        F.coalesce(
            F.when(F.trim(f["name"]) != "", f["name"]),
            F.nullif(F.regexp_extract(f["regex"], _GROUP_NAME, 1), F.lit("")),
            F.concat(F.lit("field_"), (i + 1).cast("string"))).alias("name"),
        f["regex"].alias("regex")))


def normalize_extraction(df: DataFrame, content: str) -> DataFrame:
    """One shape for the variants of an extraction response; every key is read on its own.

    ``error`` is set for text that is no JSON object.
    """
    parsed = df.withColumn("_r", F.from_json(content, EXTRACTION_SCHEMA))
    r, t = (lambda k: F.col(f"_r.{k}")), (lambda k: F.col(f"_r.timestamp_analysis.{k}"))
    renamed = F.transform(r("field_extractions"), lambda f: F.struct(
        F.coalesce(f["field"], F.lit("unknown")).alias("name"),
        F.coalesce(f["regex"], F.lit("")).alias("regex")))
    bad = ~F.coalesce(F.ltrim(content).startswith("{"), F.lit(False)) | F.try_parse_json(content).isNull()
    return parsed.withColumns({
        "sourcetype": F.coalesce(r("sourcetype"), F.lit("custom_log")),
        "fields": F.coalesce(name_fields(r("fields")), renamed, F.array().cast(_FIELDS)),
        "combined_regex": F.coalesce(r("combined_regex"), r("combined_extraction")),
        "time_format": F.coalesce(r("time_format"), t("TIME_FORMAT"), F.lit(CURRENT_TIME)),
        "time_prefix": F.coalesce(r("time_prefix"), t("TIME_PREFIX"), F.lit("")),
        "max_timestamp_lookahead": F.coalesce(
            r("max_timestamp_lookahead"), t("MAX_TIMESTAMP_LOOKAHEAD"), F.lit(str(DEFAULT_LOOKAHEAD))),
        "source": F.coalesce(r("source"), F.lit("suggested")),
        "error": F.when(bad, "Failed to parse response"),
    }).drop("_r")


def mapping_items(df: DataFrame, content: str) -> DataFrame:
    """Mapping suggestions from an array, or from an object whose only key holds the array.

    The two forms are told apart first: parsing an object as an array gives a row of NULLs.
    """
    text = F.col(content)
    listed = F.from_json(text, f"array<{MAPPING_ITEM}>")
    wrapped = F.get(F.map_values(F.from_json(text, f"map<string,array<{MAPPING_ITEM}>>")), 0)
    valid = F.try_parse_json(text).isNotNull()
    items = F.when(valid & F.ltrim(text).startswith("["), listed).when(
        valid & (F.size(F.json_object_keys(text)) == 1), wrapped)
    return df.withColumn("items", items).withColumn(
        "error", F.when(F.col("items").isNull(), "Failed to parse response"))


def explode_items(df: DataFrame, keys: list[str]) -> DataFrame:
    return each(df, keys, "items").select(*keys, "s.*")


def valid_items(items: DataFrame, fields: DataFrame, model_fields: DataFrame, by: str) -> DataFrame:
    """Suggestions for a field that exists and a model field of the model."""
    known = fields.select(by, F.col("name").alias("field")).distinct()
    targets = model_fields.select(F.col("cim_field").alias("cimField")).distinct()
    return items.join(known, [by, "field"], "left_semi").join(targets, "cimField", "left_semi")


def rejected_items(items: DataFrame, fields: DataFrame, model_fields: DataFrame, by: str) -> DataFrame:
    """The other suggestions, with the reason."""
    known = fields.select(by, F.col("name").alias("field")).distinct().withColumn("_known", F.lit(True))
    targets = model_fields.select(
        F.col("cim_field").alias("cimField")).distinct().withColumn("_target", F.lit(True))
    flagged = items.join(known, [by, "field"], "left").join(targets, "cimField", "left")
    reason = F.when(F.col("_known").isNull(), "unknown field").when(
        F.col("_target").isNull(), "unknown model field")
    return flagged.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_known", "_target")
