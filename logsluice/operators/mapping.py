"""Mapping of fields to the common information model: suggestions, quality, aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsluice.functions.literals import lookup, struct_array, text_array
from logsluice.functions.rows import each
from logsluice.functions.typing import quality_label
from logsluice.sources.dimensions import CIM_MODELS, cim_fields, model_rows, synonym_rows


def _synonym_array(models: dict[str, list[str]]) -> Column:
    return struct_array(synonym_rows(models), ["cim_field", "pattern"])


def field_names(records: DataFrame, by: str = "sourcetype") -> DataFrame:
    """Distinct names of a sourcetype with their first position."""
    return records.groupBy(by, "name").agg(F.min("pos").alias("pos"))


def candidates(names: DataFrame, by: str, models: dict[str, list[str]] | None = None) -> DataFrame:
    """``(by, name, pos, cim_field)`` for names equal to a synonym, containing one, or contained
    in one.

    The synonyms are a literal array that is filtered inside the row of a name, so there is no join
    and the work grows with the number of names alone.
    """
    return each(names, [by, "name", "pos"], _matched_fields(models or CIM_MODELS), "cim_field")


def _matched_fields(models: dict[str, list[str]]) -> Column:
    """The model fields that the column ``name`` matches."""
    lower = F.lower("name")
    hits = F.filter(
        _synonym_array(models),
        lambda s: lower.contains(s["pattern"]) | s["pattern"].contains(lower))
    return F.array_distinct(F.transform(hits, lambda s: s["cim_field"]))


def _per_model(df: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    """Repeat each row for the models that have its ``cim_field``."""
    holders: dict[str, list[str]] = {}
    for model, fields in models.items():
        for f in fields:
            holders.setdefault(f, []).append(model)
    found = lookup(F.col("cim_field"), {f: ",".join(ms) for f, ms in holders.items()})
    return each(df, df.columns, F.split(found, ","), "model")


def auto_map(
    names: DataFrame, by: str = "sourcetype", models: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The first matching field of every model field, per group and model."""
    models = models or CIM_MODELS
    first = candidates(names, by, models).groupBy(by, "cim_field").agg(
        F.min_by("name", F.struct("pos", "name")).alias("name"))
    return _per_model(first, models).select(by, "model", "cim_field", "name")


def similarity(name: Column, pattern: Column) -> Column:
    """1 for equal texts, 0.8 if one holds the other, else one minus the relative edit distance."""
    lower = F.lower(name)
    return (
        F.when(lower == pattern, 1.0)
        .when(lower.contains(pattern) | pattern.contains(lower), 0.8)
        .otherwise(F.round(
            1.0 - F.levenshtein(lower, pattern) / F.greatest(F.length(lower), F.length(pattern)), 4)))


def fuzzy_map(
    names: DataFrame, by: str = "sourcetype", min_score: float = 0.6,
    models: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The best instead of the first field of every model field, with its score."""
    models = models or CIM_MODELS
    scored = F.transform(_synonym_array(models), lambda s: F.struct(
        s["cim_field"].alias("cim_field"), similarity(F.col("name"), s["pattern"]).alias("score")))
    kept = F.filter(scored, lambda s: s["score"] >= min_score)
    rows = each(names, [by, "name", "pos"], kept).select(by, "name", "pos", "s.*")
    return rows.groupBy(by, "cim_field").agg(
        F.max("score").alias("score"),
        F.min_by("name", F.struct(-F.col("score"), F.col("pos"), F.col("name"))).alias("name"))


def one_to_one(fuzzy: DataFrame, by: str = "sourcetype") -> DataFrame:
    """Of several model fields that chose the same field keep the best, ties by name."""
    return fuzzy.groupBy(by, "name").agg(
        F.min_by(F.struct("cim_field", "score"), F.struct(-F.col("score"), F.col("cim_field"))).alias("m"),
    ).select(by, "name", "m.*")


def lookup_model(spark: SparkSession, df: DataFrame, model: str, variant: str = "ui") -> DataFrame:
    """Number of fields of the named model, or an error for an unknown name.

    The dimension has one row per model, a fixed ten, so it is broadcast.
    """
    sizes = cim_fields(spark).filter(F.col("variant") == variant).groupBy(
        F.col("model").alias(model)).agg(F.count("*").alias("model_fields"))
    return df.join(F.broadcast(sizes), model, "left").withColumn("error", F.when(
        F.col("model_fields").isNull(),
        F.concat(F.lit("Invalid CIM model specified: "), F.coalesce(model, F.lit("")))))


def quality(mapped: Column, total: Column) -> Column:
    """Mapped model fields in percent, rounded half up."""
    return F.round(100 * mapped / total).cast("int")


def compliance(
    names: DataFrame, by: str = "sourcetype", models: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Quality of every group under every model, groups and models without a match included.

    One aggregate: the set of matched model fields of a group has at most as many members as there
    are synonym entries, and all models are measured against it in the group's single row.
    """
    models = models or CIM_MODELS
    none = F.array().cast("array<string>")
    hits = names.select(by, F.coalesce(_matched_fields(models), none).alias("hits"))
    per_group = hits.select(by, F.explode_outer("hits").alias("cim_field")).groupBy(by).agg(
        F.collect_set("cim_field").alias("found"))
    measures = F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.lit(len(f)).alias("total"),
            F.size(F.array_intersect("found", text_array(f))).cast("bigint").alias("mapped"))
        for m, f in models.items()])
    rows = per_group.select(by, F.inline(measures))
    percent = quality(F.col("mapped"), F.col("total"))
    return rows.withColumn("quality", percent).withColumn("label", quality_label(F.col("quality")))


def best_model(compliance_: DataFrame, by: str = "sourcetype") -> DataFrame:
    return compliance_.groupBy(by).agg(
        F.min_by(F.struct("model", "quality", "label"),
                 F.struct(-F.col("quality"), F.col("model"))).alias("b")).select(by, "b.*")


# --- Aliases ------------------------------------------------------------------------------------

def alias_fields(df: DataFrame, mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """Copy fields under their model names in one projection; blank targets and same names drop."""
    return df.withColumns({
        cim: F.col(f"`{field}`") for field, cim in mapping
        if cim and cim != field and field in df.columns})


def rename_fields(df: DataFrame, mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace fields by their model names."""
    return df.withColumnsRenamed({f: c for f, c in mapping if c and f in df.columns})


def model_table(variant: str = "ui") -> list[tuple[str, str, int]]:
    return model_rows(variant)
