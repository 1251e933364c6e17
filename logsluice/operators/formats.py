"""Format of a line, of a sourcetype, and the sourcetype to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsluice.functions import patterns as P

_SYSLOG_ANY = "|".join((P.SYSLOG_STANDARD, P.SYSLOG_3164, P.SYSLOG_5424))
_XML_ANY = "|".join((P.XML_SIMPLE, P.XML_SELF_CLOSING, P.XML_WITH_ATTRIBUTES))


def _is_json_object(raw: Column) -> Column:
    return F.ltrim(raw).startswith("{") & F.try_parse_json(raw).isNotNull()


def detect_format(raw: Column, has_header: Column | None = None) -> Column:
    """json, csv, apache, kv, syslog or xml, as the first step of onboarding decides.

    XML overrides syslog, which overrides the others. A comma makes a line CSV only if the sample
    has more than one line, which ``has_header`` tells; by default it has.
    """
    several = F.lit(True) if has_header is None else has_header
    return (
        F.when(F.ltrim(raw).startswith("<") & raw.rlike(_XML_ANY), "xml")
        .when(raw.rlike(_SYSLOG_ANY), "syslog")
        .when(_is_json_object(raw), "json")
        .when(several & raw.contains(","), "csv")
        .when(raw.rlike(P.APACHE_SHAPE), "apache")
        .otherwise("kv"))


CSV_SHARE = 0.9


def unquoted_separators(raw: Column, sep: str = ",") -> Column:
    """Separators of a line outside of quotes."""
    return F.size(F.split(F.regexp_replace(raw, r'"(?:[^"]|"")*"', ""), sep)) - 1


def format_without_csv(raw: Column) -> Column:
    """Like :func:`detect_format`, with the variant of syslog, for lines of which CSV is not known yet.

    What has a shape of its own is that, whatever commas it holds; the rest is ``kv``.
    """
    return (
        F.when(F.ltrim(raw).startswith("<") & raw.rlike(P.SYSLOG_5424), "syslog_5424")
        .when(F.ltrim(raw).startswith("<") & raw.rlike(P.SYSLOG_3164), "syslog_3164")
        .when(F.ltrim(raw).startswith("<") & raw.rlike(_XML_ANY), "xml")
        .when(raw.rlike(P.SYSLOG_STANDARD), "syslog")
        .when(_is_json_object(raw), "json")
        .when(raw.rlike(P.APACHE_SHAPE), "apache")
        .otherwise("kv"))


def csv_sourcetypes(df: DataFrame, raw: str = "raw", by: str = "sourcetype", sep: str = ",") -> DataFrame:
    """Sourcetypes whose lines are CSV: of those without a shape of their own nearly all have the same number
    of separators, at least one, and fewer than half hold pairs."""
    line = F.col(raw)
    plain = df.filter(format_without_csv(line) == "kv").select(
        by, unquoted_separators(line, sep).alias("seps"), line.rlike(P.KV_PAIR).cast("int").alias("pairs"))
    counts = plain.groupBy(by, "seps").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs"))
    return counts.groupBy(by).agg(
        F.max_by("seps", "n").alias("seps"), F.max("n").alias("most"), F.sum("n").alias("lines"),
        F.sum("pairs").alias("pairs")).filter(
        (F.col("seps") > 0) & (F.col("most") >= CSV_SHARE * F.col("lines")) & (2 * F.col("pairs") < F.col("lines"))
    ).select(by, "seps", "lines")


def detect_line_format(raw: Column, fields: int = 2, has_existing: bool = False) -> Column:
    """apache_access, json_log, csv_log, kv_log, custom_log or sample_log, as the last step decides.

    ``fields`` is the number of new fields; ``has_existing`` is set when the data already has
    fields, which rules out the complete access log extraction.
    """
    chain = F.when(raw.rlike(P.APACHE_SHAPE) & F.lit(not has_existing), "apache_access")
    chain = chain.when(F.ltrim(raw).startswith("{") & raw.contains(":"), "json_log")
    chain = chain.when(raw.contains(",") & F.lit(fields > 1), "csv_log")
    chain = chain.when(raw.contains("="), "kv_log")
    return chain.otherwise("custom_log" if has_existing else "sample_log")


def majority_format(df: DataFrame, by: str = "sourcetype", fmt: str = "fmt") -> DataFrame:
    """The most frequent format per sourcetype and its share; ties by name.

    Both aggregates combine on the map side, so a sourcetype with most of the rows costs one row
    per format and partition.
    """
    counts = df.groupBy(by, fmt).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(fmt, "n"), F.struct(-F.col("n"), F.col(fmt)))
    return counts.groupBy(by).agg(best.alias("best"), F.sum("n").alias("lines")).select(
        by, F.col(f"best.{fmt}").alias(fmt), "lines",
        F.round(F.col("best.n") / F.col("lines"), 4).alias("share"))


def resolve_sourcetype(override: Column, actual: Column, detected: Column) -> Column:
    """The user's choice, else the sourcetype of the data, else the detected one."""
    return F.coalesce(F.nullif(override, F.lit("")), F.nullif(actual, F.lit("")), detected)
