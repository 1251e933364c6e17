"""Field extraction from one line.

Functions return a column per field name, or an array of ``struct(name, value)`` in line order.
Each scans the line once: the parts of a match are cut from the match, not searched for again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logsluice.functions import patterns as P
from logsluice.functions.regexlang import split_named_groups
from logsluice.functions.rows import bind, first_flags

_MARK, _SEP = "\x1e", "\x1f"
_PAIRS = "array<struct<name:string,value:string>>"


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _pair(name: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"))


# --- Groups of one pattern ----------------------------------------------------------------------

def _marked_groups(raw: Column, pattern: str, count: int) -> Column:
    """``[mark, group 1, …]`` of the first match; without a match the first element is no mark.

    ``regexp_extract`` runs the pattern once per group. Here one replacement writes all groups next
    to each other and a split takes them apart. A line that already holds one of the two control
    characters takes the longer way, so the result is the same for every text.
    """
    whole = rf"\A[\s\S]*?(?:{pattern})[\s\S]*\z"
    joined = F.regexp_replace(
        raw, whole, _SEP.join([_MARK, *(f"${i}" for i in range(1, count + 1))]))
    groups = [F.regexp_extract(raw, pattern, i) for i in range(1, count + 1)]
    slow = F.when(raw.rlike(pattern), F.array(F.lit(_MARK), *groups))
    return F.when(raw.contains(_MARK) | raw.contains(_SEP), slow).otherwise(F.split(joined, _SEP))


def group_values(raw: Column, pattern: str, count: int) -> Column:
    """All groups of the first match as an array; NULL without a match, '' for an unset group."""
    return bind(
        _marked_groups(raw, pattern, count),
        lambda g: F.when(F.get(g, 0) == _MARK, F.slice(g, 2, count)))


def with_groups(
    df: DataFrame, pattern: str, names: Sequence[str | None], raw: str = "raw",
) -> DataFrame:
    """Add one column per named group of the first match, NULL where the group is unset."""
    # The array is a projection of its own, so the pattern runs once per line.
    parts = df.withColumn("_groups", _marked_groups(F.col(raw), pattern, len(names)))
    matched = F.get("_groups", 0) == _MARK
    return parts.withColumns({
        name: F.when(matched, empty_to_null(F.get("_groups", i + 1)))
        for i, name in enumerate(names) if name
    }).drop("_groups")


def with_named_groups(df: DataFrame, pattern: str, raw: str = "raw") -> DataFrame:
    """Like :func:`with_groups` for a pattern that names its groups."""
    return with_groups(df, *split_named_groups(pattern), raw=raw)


# --- Known line formats -------------------------------------------------------------------------

def apache_common(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The seven groups of a common log line and the request split into its three parts."""
    fields = with_groups(df, P.APACHE_COMMON, P.APACHE_COMMON_NAMES, raw)
    parts = F.split("request", " ")
    part = lambda i: F.when(F.size(parts) >= 3, F.get(parts, i))
    return fields.withColumns({"method": part(0), "uri": part(1), "protocol": part(2)})


def apache_access(df: DataFrame, raw: str = "raw") -> DataFrame:
    return with_groups(df, P.APACHE_ACCESS, P.APACHE_ACCESS_NAMES, raw)


def syslog_standard(df: DataFrame, raw: str = "raw") -> DataFrame:
    return with_groups(df, P.SYSLOG_STANDARD, P.SYSLOG_STANDARD_NAMES, raw)


def _with_priority_parts(df: DataFrame) -> DataFrame:
    priority = F.col("priority").try_cast("int")
    return df.withColumns({
        "facility": F.floor(priority / 8).cast("int"), "severity": priority % 8})


def syslog_3164(df: DataFrame, raw: str = "raw") -> DataFrame:
    return _with_priority_parts(with_groups(df, P.SYSLOG_3164, P.SYSLOG_3164_NAMES, raw))


def syslog_5424(df: DataFrame, raw: str = "raw") -> DataFrame:
    return _with_priority_parts(with_groups(df, P.SYSLOG_5424, P.SYSLOG_5424_NAMES, raw))


# --- Key-value pairs ----------------------------------------------------------------------------

_AROUND_VALUE = ' \t\n\r\x0b\f"'


def _split_pairs(matches: Column, divider: str) -> Column:
    """``name<divider>value`` texts to structs. The value holds neither spaces nor quotes inside, so
    what surrounds it can be trimmed."""
    return F.transform(matches, lambda match: _pair(
        F.rtrim(F.substring_index(match, divider, 1)),
        F.trim(F.substr(match, F.instr(match, divider) + 1), F.lit(_AROUND_VALUE))))


def _split_quoted_pairs(matches: Column) -> Column:
    """``name=value`` texts whose value may hold spaces and quotes: only a closed pair of quotes
    around all of it goes."""
    def cut(match: Column) -> Column:
        value = F.substr(match, F.instr(match, "=") + 1)
        return _pair(F.substring_index(match, "=", 1), bind(value, lambda v: F.when(
            v.startswith('"') & v.endswith('"') & (F.length(v) > 1),
            F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)))

    return F.transform(matches, cut)


def first_per_name(pairs: Column) -> Column:
    """Keep the first pair of each name, in order."""
    def first(every: Column) -> Column:
        kept = F.filter(first_flags(F.transform(every, lambda p: p["name"])), lambda f: f["first"])
        return F.transform(kept, lambda f: F.get(every, f["place"]))

    return bind(pairs, first)


def kv_pairs(raw: Column) -> Column:
    """All ``name=value`` and ``name="value"`` of a line; a quoted value holds no space."""
    return _split_pairs(F.regexp_extract_all(raw, F.lit(P.KV_PAIR), F.lit(0)), "=")


def kv_dialects(raw: Column) -> Column:
    """``k=v``, then ``k: v``, then ``k = v``; one pair per name, the first dialect wins."""
    found = [
        _split_pairs(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), divider)
        for pattern, divider in ((P.KV_PAIR, "="), (P.KV_COLON, ":"), (P.KV_SPACED, "="))
    ]
    return first_per_name(F.concat(*found))


def kv_quoted(raw: Column) -> Column:
    """Pairs whose quoted value may hold spaces; unquoted values end at a comma."""
    return _split_quoted_pairs(F.regexp_extract_all(raw, F.lit(P.KV_QUOTED), F.lit(0)))


def pair_value(pairs: Column, name: str) -> Column:
    """The first value under a name, NULL if absent."""
    place = F.array_position(pairs["name"], F.lit(name)).cast("int")
    return F.get(pairs["value"], place - 1)


# --- JSON ---------------------------------------------------------------------------------------

def json_pairs(raw: Column) -> Column:
    """Top-level keys of a JSON object as ``struct(name, value VARIANT)``; NULL for other text.

    Of a repeated key the last value counts.
    """
    entries = F.map_entries(F.from_json(raw, "map<string,variant>"))
    pairs = F.transform(
        F.reverse(entries), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return F.reverse(first_per_name(pairs))


def variant_text(value: Column) -> Column:
    """A VARIANT as text: strings unquoted, containers as JSON, null as ``null``."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("null"))


# --- XML ----------------------------------------------------------------------------------------

def xml_simple(raw: Column) -> Column:
    """``<t>v</t>`` pairs."""
    found = F.regexp_extract_all(raw, F.lit(P.XML_SIMPLE), F.lit(0))
    return F.transform(found, lambda m: _pair(
        F.substring_index(F.substr(m, F.lit(2)), ">", 1),
        F.regexp_extract(m, P.XML_SIMPLE, 2)))


def xml_self_closing(raw: Column) -> Column:
    """``<t a="v" …/>``: the first attribute as ``t_a``; without one the tag and its raw text."""
    found = F.regexp_extract_all(raw, F.lit(P.XML_SELF_CLOSING), F.lit(0))

    def one(match: Column) -> Column:
        tag = F.regexp_extract(match, P.XML_SELF_CLOSING, 1)
        body = F.regexp_extract(match, P.XML_SELF_CLOSING, 2)
        has_attribute = body.rlike(P.XML_ATTRIBUTE)
        return _pair(
            F.when(has_attribute, F.concat_ws("_", tag, F.regexp_extract(body, P.XML_ATTRIBUTE, 1)))
            .otherwise(tag),
            F.when(has_attribute, F.regexp_extract(body, P.XML_ATTRIBUTE, 2)).otherwise(body))

    return F.transform(found, one)


def xml_with_attributes(raw: Column) -> Column:
    """``<t a="v" …>content</t>``: every attribute as ``t_a``, then the content under ``t``."""
    found = F.regexp_extract_all(raw, F.lit(P.XML_WITH_ATTRIBUTES), F.lit(0))

    def one(match: Column) -> Column:
        tag = F.regexp_extract(match, P.XML_WITH_ATTRIBUTES, 1)
        body = F.regexp_extract(match, P.XML_WITH_ATTRIBUTES, 2)
        attributes = F.transform(
            F.regexp_extract_all(body, F.lit(P.XML_ATTRIBUTE), F.lit(0)),
            lambda a: _pair(
                F.concat_ws("_", tag, F.regexp_extract(a, P.XML_ATTRIBUTE, 1)),
                F.regexp_extract(a, P.XML_ATTRIBUTE, 2)))
        content = F.array(_pair(tag, F.regexp_extract(match, P.XML_WITH_ATTRIBUTES, 3)))
        return F.concat(attributes, content)

    return F.flatten(F.transform(found, one))


def xml_auto(raw: Column) -> Column:
    """Pairs of the first of the three XML shapes that occurs in the line."""
    return (
        F.when(raw.rlike(P.XML_SIMPLE), xml_simple(raw))
        .when(raw.rlike(P.XML_SELF_CLOSING), xml_self_closing(raw))
        .when(raw.rlike(P.XML_WITH_ATTRIBUTES), xml_with_attributes(raw))
        .otherwise(F.array().cast(_PAIRS))
    )


# --- Generic patterns ---------------------------------------------------------------------------

def generic_fields(raw: Column) -> dict[str, Column]:
    """timestamp, ip_address, log_level and email of a line of unknown format."""
    return {
        name: empty_to_null(F.regexp_extract(raw, pattern, 1))
        for name, pattern in P.GENERIC_PATTERNS.items()
    }


# --- User patterns ------------------------------------------------------------------------------

def all_matches(raw: Column, pattern: str) -> Column:
    """Whole matches of a pattern, named groups or not."""
    return F.regexp_extract_all(raw, F.lit(split_named_groups(pattern)[0]), F.lit(0))


def named_group_pairs(raw: Column, pattern: str) -> Column:
    """Per group name, the first non-empty value over all matches; absent names are left out."""
    positional, names = split_named_groups(pattern)
    pairs = [
        _pair(
            F.lit(name),
            F.get(F.filter(
                F.regexp_extract_all(raw, F.lit(positional), F.lit(i + 1)), lambda v: v != ""), 0))
        for i, name in enumerate(names) if name
    ]
    return F.when(
        raw.rlike(positional), F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def numbered_group_pairs(raw: Column, pattern: str) -> Column:
    """``extracted_field_<i>`` for the non-empty groups of the first match."""
    count = len(split_named_groups(pattern)[1])
    values = group_values(raw, pattern, count)
    pairs = F.transform(values, lambda v, i: _pair(
        F.concat(F.lit("extracted_field_"), (i + 1).cast("string")), v))
    return F.filter(pairs, lambda p: p["value"] != "")


def match_pairs(raw: Column, pattern: str) -> Column:
    """``regex_match_<k>`` for each match of a pattern without groups."""
    return F.transform(all_matches(raw, pattern), lambda v, i: _pair(
        F.concat(F.lit("regex_match_"), (i + 1).cast("string")), v))


def combined_records(raw: Column, pattern: str) -> Column:
    """Every match of a combined pattern as an array of its group values, in group order."""
    positional, names = split_named_groups(pattern)
    return F.transform(
        all_matches(raw, pattern), lambda m: group_values(m, positional, len(names)))


def preview_values(raw: Column, pattern: str, name: str) -> Column:
    """What a field pattern yields at every match in a line: the named group, else group 1, else the match.

    Empty values are left out.
    """
    positional, names = split_named_groups(pattern)
    group = names.index(name) + 1 if name in names else 1 if names else 0
    return F.filter(F.regexp_extract_all(raw, F.lit(positional), F.lit(group)), lambda v: v != "")


def preview_value(raw: Column, pattern: str, name: str) -> Column:
    """What a field pattern yields for a line: the named group, else group 1, else the match."""
    positional, names = split_named_groups(pattern)
    if name in names:
        group = names.index(name) + 1
    else:
        group = 1 if names else 0
    value = empty_to_null(F.regexp_extract(raw, positional, group))
    if group > 1:
        value = F.coalesce(value, empty_to_null(F.regexp_extract(raw, positional, 1)))
    return value
