"""Timestamp formats: detection and parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logsluice.functions.patterns import (
    CURRENT_TIME, DEFAULT_LOOKAHEAD, JAVA_TIME_FORMATS, TIME_FORMATS_ISO_FIRST,
    TIME_FORMATS_SLASH_FIRST,
)


def detect_time_format(raw: Column, slash_first: bool = False) -> Column:
    """The strftime format of the first known timestamp shape in the line, else CURRENT_TIME."""
    shapes = TIME_FORMATS_SLASH_FIRST if slash_first else TIME_FORMATS_ISO_FIRST
    first, *rest = shapes
    chain = F.when(raw.rlike(first[0]), first[1])
    for pattern, fmt in rest:
        chain = chain.when(raw.rlike(pattern), fmt)
    return chain.otherwise(CURRENT_TIME)


def json_time_prefix(raw: Column) -> Column:
    """The text in front of the time of a JSON line, by the key that is present."""
    return (
        F.when(raw.contains('"timestamp"'), '"timestamp":"')
        .when(raw.contains('"time"'), '"time":"')
        .otherwise("")
    )


def after_prefix(raw: Column, prefix: str, lookahead: int) -> Column:
    """The ``lookahead`` characters behind the first match of the prefix pattern; NULL without one."""
    if not prefix or prefix == "^":
        return F.substring(raw, 1, lookahead)
    rest = F.get(F.split(raw, prefix, 2), 1)
    return F.substring(rest, 1, lookahead)


def parse_time(
    raw: Column, fmt: str, prefix: str = "", lookahead: int = DEFAULT_LOOKAHEAD,
    ingest_time: Column | None = None,
) -> Column:
    """Parse the event time. CURRENT_TIME stands for the ingest time.

    A format without a year takes it from the ingest time; a result later than one day after
    ingest belongs to the year before (lines of 31 December read on 1 January).
    """
    ingest = F.current_timestamp() if ingest_time is None else ingest_time
    if not fmt or fmt == CURRENT_TIME:
        return ingest
    cut, java = JAVA_TIME_FORMATS[fmt]
    text = F.regexp_extract(after_prefix(raw, prefix, lookahead), cut, 0)
    if java is None:
        return iso_time(text)
    text = F.regexp_replace(text, r"\s+", " ")
    if "yyyy" in java:
        return F.try_to_timestamp(text, F.lit(java))
    return with_year(text, java, ingest)


def iso_time(text: Column) -> Column:
    """A date and time with an optional fraction and zone; without a zone it is UTC's, the session's."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\s+(?=[+Z-])", ""), ",", ".")
    return F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def time_prefix(before: Column, fmt: Column, sep: str = ",") -> Column:
    """A pattern for what leads to the time, from the text in front of it.

    The JSON key, the pair's name or the XML tag if one leads to the time, the number of separators in a
    CSV line; '' if none does, and then the whole line is searched.
    """
    key = F.regexp_extract(before, r'"([\w.@-]+)"\s*:\s*"?$', 1)
    name = F.regexp_extract(before, r'([\w.@-]+)="?$', 1)
    tag = F.regexp_extract(before, r"<([\w.-]+)>$", 1)
    columns = F.size(F.split(F.regexp_replace(before, r'"(?:[^"]|"")*"', ""), sep)) - 1
    return (
        F.when((fmt == "json") & (key != ""), F.concat(F.lit('"'), key, F.lit(r'"\s*:\s*"?')))
        .when((fmt == "xml") & (tag != ""), F.concat(F.lit("<"), tag, F.lit(">")))
        .when(fmt == "csv", F.when(columns > 0, F.concat(
            F.lit(rf'^(?:(?:"(?:[^"]|"")*"|[^{sep}"])*{sep}){{'), columns.cast("string"), F.lit("}"))).otherwise("^"))
        .when(name != "", F.concat(F.lit(r"\b"), name, F.lit('="?')))
        .otherwise(""))


def with_year(text: Column, java: str, ingest: Column) -> Column:
    """Parse a time without a year next to an ingest time."""
    def in_year(year: Column) -> Column:
        stamped = F.concat(year.cast("string"), F.lit(" "), text)
        return F.try_to_timestamp(stamped, F.lit("yyyy " + java))

    year = F.year(ingest)
    same = in_year(year)
    late = same > ingest + F.expr("INTERVAL 1 DAY")
    # 29 February exists in only one of the two years.
    return F.when(late | same.isNull(), in_year(year - 1)).otherwise(same)
