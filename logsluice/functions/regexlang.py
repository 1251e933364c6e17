"""Regular expression dialects: named groups to positions, naming, validation.

Driver-side helpers for short rule text. Java accepts neither ``(?P<n>`` nor an underscore in a
group name, so a pattern is rewritten once to positional groups plus an ordered list of names.
"""

from __future__ import annotations

import re
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from logsluice.functions.patterns import COMMON_GROUP_NAMES

# An escaped character, a whole character class, or an opening parenthesis with its group prefix.
_TOKEN = re.compile(
    r"(?P<skip>\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\])"
    r"|\((?:\?P?<(?P<name>[A-Za-z_]\w*)>|(?P<special>\?)|(?P<plain>))",
    re.DOTALL,
)


def split_named_groups(pattern: str) -> tuple[str, list[str | None]]:
    """Rewrite named groups to plain ones; the name of each capture group, ``None`` if unnamed."""
    names: list[str | None] = []

    def rewrite(token: re.Match) -> str:
        if token["skip"] is not None or token["special"] is not None:
            return token[0]
        names.append(token["name"])
        return "("

    return _TOKEN.sub(rewrite, pattern), names


def name_groups(pattern: str) -> tuple[str, list[str]]:
    """Names for every capture group: its own, else the usual name at that position."""
    positional, names = split_named_groups(pattern)
    named = [
        name or (COMMON_GROUP_NAMES[i] if i < len(COMMON_GROUP_NAMES) else f"field_{i + 1}")
        for i, name in enumerate(names)
    ]
    return positional, named


def field_name(name: str | None, pattern: str, position: int) -> str:
    """A field's own name, else the first group name in its pattern, else ``field_<position>``."""
    if name and name.strip():
        return name
    found = next((n for n in split_named_groups(pattern)[1] if n), None)
    return found or f"field_{position}"


def check_pattern(spark: SparkSession, pattern: str, strict: bool = False) -> str | None:
    """``None`` if Spark accepts the pattern, else the reason.

    ``strict`` also rejects doubled quantifiers, of which Java allows two as possessive and
    reluctant forms, and patterns that match empty text, as such a match yields no value.
    """
    if strict and any(q in pattern for q in ("**", "++", "??")):
        return "doubled quantifier"
    try:
        re_text = split_named_groups(pattern)[0]
        # A constant query is folded on the driver and starts no job.
        empty = spark.sql("SELECT regexp_like('', :pattern) AS e", args={"pattern": re_text}).first()["e"]
        if strict and empty:
            return "matches empty text"
    except PySparkException as err:
        return str(err).splitlines()[0]
    return None


SLOW_MS = 100.0


def pattern_millis(spark: SparkSession, pattern: str, sample: str, runs: int = 3) -> float:
    """Milliseconds that Java needs to find all matches of a pattern in one sample text, the best of some runs.

    More than ``SLOW_MS`` on one sample is too slow for a table of them. The text is a parameter of a
    constant query, so nothing but planning is added; that share is measured with an empty text and taken off.
    """
    re_text = split_named_groups(pattern)[0]

    def once(text: str) -> float:
        begin = time.perf_counter()
        spark.sql("SELECT regexp_count(:text, :pattern)", args={"text": text, "pattern": re_text}).collect()
        return (time.perf_counter() - begin) * 1000

    return max(0.0, min(once(sample) for _ in range(runs)) - min(once("") for _ in range(runs)))


def escape_literal(text: str) -> str:
    """Escape text for a pattern, one backslash per special character."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def escape_replacement(text: str) -> str:
    """Escape text for the replacement side, where ``$`` and ``\\`` are special."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
