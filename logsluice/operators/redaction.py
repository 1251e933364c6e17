"""Redaction by span, by pattern, by field, and its check."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logsluice.functions import patterns as P
from logsluice.functions import spans as S
from logsluice.functions.regexlang import _TOKEN, escape_literal, escape_replacement, split_named_groups
from logsluice.functions.rows import bind
from logsluice.functions.spans import Detector
from logsluice.operators.detectors import (
    CANONICAL_TYPES, DETECTORS, canonical_type, value_pattern_key,
)
from logsluice.operators.pii import type_counts


def label_for(type_name: str) -> str:
    return f"[REDACTED_{type_name.upper()}]"


def custom_label(name: str | None) -> str:
    return label_for(re.sub(r"\s+", "_", name or "CUSTOM"))


def redact_spans(
    df: DataFrame, text: str, detectors: Sequence[Detector], out: str = "redacted",
) -> DataFrame:
    """Replace every span by its label; overlapping spans become one label."""
    found = df.withColumn("_spans", S.detect_all(text, detectors))
    merged = found.withColumn("_islands", S.merge_overlaps(F.col("_spans")))
    return merged.withColumn(out, S.replace_islands(
        F.col(text), F.col("_islands"), lambda t: S.redaction_label(canonical_type(t)))
    ).drop("_spans", "_islands")


LEAD = "(?<lead>"


def replacement(rule: Sequence[str]) -> str:
    """The replacement text of a rule; a pattern with a lead group keeps what leads to the value."""
    kept = "${lead}" if LEAD in rule[0] else ""
    return kept + escape_replacement(rule[1])


def redact_patterns(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Replace all matches of each ``(pattern, label)`` in order, over the whole event.

    The patterns are literals, so each is compiled once per task.
    """
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], replacement(rule)), rules, text)


def fused_groups(rules: Sequence[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Rules that can share a scan, in order: as many as stand beside each other.

    A rule that refers back to a group, whose number a shared pattern would change, or that may match nothing is on its own.
    """
    groups: list[list[tuple[str, str]]] = []
    alone = True
    for rule in rules:
        own = not _fusible(rule[0])
        if own or alone:
            groups.append([])
        groups[-1].append(rule)
        alone = own
    return groups


def _fusible(pattern: str) -> bool:
    bare = re.sub(r"\\Q.*?(?:\\E|$)|\\\\", "", pattern, flags=re.DOTALL)
    if re.search(r"\\(?:[1-9]|k<|G)", bare) or "\\Q" in pattern:
        return False
    try:
        return re.match(pattern.replace(LEAD, "(?P<lead>"), "") is None
    except re.error:  # Java's own syntax, in which nothing tells whether it matches empty text
        return False


def _branch(pattern: str) -> tuple[str, bool]:
    """The pattern with one group around it, and one around what leads to the value if there is that."""
    has_lead = LEAD in pattern
    held = pattern.replace(LEAD, "(?<lead>", 1)

    def plain(token: re.Match) -> str:
        if token["skip"] is not None or token["special"] is not None:
            return token[0]
        return "(" if token["name"] == "lead" else "(?:"

    return f"({_TOKEN.sub(plain, held)})", has_lead


def any_gate(text: Column, detectors: Sequence[Detector]) -> Column:
    """Whether some detector may match: literal gates first, then all others in one short pattern."""
    gates = [(d.gate or d.pattern, d.gate is not None and d.gate_is_literal) for d in detectors]
    shown = [text.contains(g) for g in dict.fromkeys(g for g, literal in gates if literal)]
    patterns = list(dict.fromkeys(g for g, literal in gates if not literal))
    if patterns:
        shown.append(text.rlike("|".join(f"(?:{p})" for p in patterns)))
    return reduce(lambda a, b: a | b, shown, F.lit(False))


def redact_detectors(text: Column, names: Sequence[str]) -> Column:
    """All named detectors in one scan, of texts only that pass one of their gates."""
    chosen = [n for n in names if n in DETECTORS]
    redacted = redact_once(text, detector_rules(chosen))
    return F.when(any_gate(text, [DETECTORS[n] for n in chosen]), redacted).otherwise(text)


def redact_once(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Replace all matches of all ``(pattern, label)`` rules in one scan.

    The patterns are branches of one pattern with numbered groups. The scan marks each match and what its groups hold;
    the first branch that holds something gives the label. The leftmost match counts, of those that begin at one place
    the earlier rule; a text or label that one rule has put in is not seen by the others. Where matches of
    different rules don't touch, the result is that of :func:`redact_patterns`. Marks that a text already holds count as
    U+FFFD. NULL stays NULL.
    """
    def scanned(acc: Column, group: list[tuple[str, str]]) -> Column:
        if len(group) == 1:
            return F.regexp_replace(acc, group[0][0], replacement(group[0]))
        return bind(acc, lambda t: _scan(t, group))

    return reduce(scanned, fused_groups(list(rules)), text)


def _scan(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    branches, marks, places = [], "", []
    number = 1
    for pattern, label in rules:
        branch, has_lead = _branch(pattern)
        branches.append(branch)
        marks += f"{S._GROUP}${number}" + (f"{S._GROUP}${number + 1}" if has_lead else "")
        places.append((label, has_lead))
        number += 1 + has_lead
    own = f"[{S._OPEN}{S._GROUP}{S._CLOSE}]"
    clean = F.when(text.rlike(own), F.regexp_replace(text, own, "\ufffd")).otherwise(text)
    marked = F.regexp_replace(clean, "|".join(branches), f"{S._OPEN}{marks}{S._CLOSE}")

    def hit(piece: Column) -> Column:
        def shown(held: Column) -> Column:
            found, at = F.lit(""), 1
            cases = []
            for label, has_lead in places:
                cases.append((F.get(held, F.lit(at)) != "", F.concat(F.get(held, F.lit(at + 1)), F.lit(label)) if has_lead else F.lit(label)))
                at += 1 + has_lead
            for test, value in reversed(cases):
                found = F.when(test, value).otherwise(found)
            return F.concat(found, F.substring_index(piece, S._CLOSE, -1))

        return bind(F.split(F.substring_index(piece, S._CLOSE, 1), S._GROUP), shown)

    def joined(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), hit)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return bind(marked, lambda m: F.when(m.contains(S._OPEN), bind(F.split(m, S._OPEN), joined)).otherwise(m))


def detector_rules(names: Sequence[str]) -> list[tuple[str, str]]:
    """Pattern rules of detectors: their redaction pattern, else the pattern they search with.

    A detector that finds a value in its context keeps the context. Detectors that run as joins have no rule.
    """
    return [detector_rule(n) for n in names if n in DETECTORS]


def detector_rule(name: str) -> tuple[str, str]:
    detector = DETECTORS[name]
    pattern = P.REDACTION_PATTERNS.get(name, detector.pattern)
    if detector.in_context:
        pattern = re.sub(r"\((?!\?)", LEAD, pattern, count=1)
    return pattern, label_for(CANONICAL_TYPES[name])


# How a line shows a field: a test of line and name, and the frame around value and label that stays. ``{n}`` is the
# escaped name, ``{v}`` the value's pattern, ``{f}`` the name, ``{l}`` the label.
_FRAMES = (
    (lambda line, f: line.strip().startswith("{") and f'"{f}"' in line, r'"{n}"\s*:\s*"({v})"', '"{f}":"{l}"'),
    (lambda line, f: f"{f}=" in line, "{n}=({v})", "{f}={l}"),
    (lambda line, f: f == "clientip" and re.match(P.APACHE_SHAPE, line), "^({v})", "{l}"),
    (lambda line, f: f == "timestamp" and re.match(P.APACHE_SHAPE, line), r"\[({v})\]", "[{l}]"),
    (lambda line, f: f == "request" and re.match(P.APACHE_SHAPE, line), '"({v})"', '"{l}"'),
)


def field_rule(field: str | None, type_: str | None, sample: str) -> tuple[str, str]:
    """``(pattern, label)`` that redacts one field, by how a sample line shows it.

    A JSON key, a pair, or a place in an access log line keeps its frame; a CSV column and unknown
    lines fall back to the pattern of the type.
    """
    label = label_for(type_ or "PII")
    if not field or not sample:
        return r"[^\s]+", label
    value = P.VALUE_PATTERNS_OF_FIELDS.get(type_ or "", P.DEFAULT_VALUE_PATTERN)
    parts = {"{n}": escape_literal(field), "{v}": value, "{f}": field, "{l}": label}

    def filled(frame: str) -> str:
        return re.sub(r"\{[nvfl]\}", lambda m: parts[m[0]], frame)

    for shows, pattern, shown in _FRAMES:
        if shows(sample, field):
            return filled(pattern), filled(shown)
    return value, label


def custom_rules(patterns: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules from a user's ``(name, regex)`` pairs; blank patterns are skipped."""
    return [
        (split_named_groups(regex)[0], custom_label(name))
        for name, regex in patterns if regex and regex.strip()]


def redact_fields(df: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Replace only inside the named field: ``(field, pattern, label)``."""
    by_field: dict[str, list[tuple[str, str]]] = {}
    for field, pattern, label in rules:
        by_field.setdefault(field, []).append((pattern, label))
    present = {f: r for f, r in by_field.items() if f in df.columns}
    return df.withColumns({f: redact_patterns(F.col(f), r) for f, r in present.items()})


def redact_map_fields(fields: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """The same for a ``map<string,string>`` of fields with dynamic names."""
    def one(name: Column, value: Column) -> Column:
        return reduce(
            lambda acc, rule: F.when(
                name == rule[0], F.regexp_replace(acc, rule[1], escape_replacement(rule[2]))
            ).otherwise(acc),
            rules, value)

    return F.transform_values(fields, one)


def redact_in_context(
    df: DataFrame, text: str, detectors: Sequence[Detector], out: str = "redacted", fallback: bool = True,
) -> DataFrame:
    """Redact by the rule that the surroundings of each span suggest (pair, JSON key, position).

    A rule may miss the span it was made for, as the value it expects has another form. With ``fallback``
    a span whose text the rules leave behind is then replaced by itself.
    """
    found = df.withColumn("_spans", S.detect_all(text, detectors))
    ruled = found.withColumn("_rules", F.array_distinct(F.transform(
        "_spans", lambda s: S.context_rule(
            F.col(text), s["start"], s["end"],
            value_pattern_key(canonical_type(s["type"])), s["text"]))))
    done = ruled.withColumn(out, S.apply_rules(F.col(text), F.col("_rules")))
    if fallback:
        left = F.array_distinct(F.transform(
            F.filter("_spans", lambda s: F.col(out).contains(s["text"])),
            lambda s: F.struct(S.escaped(s["text"]).alias("pattern"), S.redaction_label(
                canonical_type(s["type"])).alias("replacement"))))
        done = done.withColumn("_rules", left).withColumn(out, F.when(
            F.size("_rules") > 0, S.apply_rules(F.col(out), F.col("_rules"))).otherwise(F.col(out)))
    return done.drop("_spans", "_rules")


def residual(df: DataFrame, text: str, detectors: Sequence[Detector]) -> DataFrame:
    """Spans that a scan still finds, by detector; labels themselves do not count."""
    bare = F.regexp_replace(F.col(text), r"\[REDACTED_[A-Z0-9_]+\]", ",")
    return type_counts(df.select(bare.alias(text)), text, detectors)


def text_fingerprint(text: Column) -> Column:
    """Length and SHA-256 of a text, to log instead of the text."""
    return F.struct(F.length(text).cast("bigint").alias("length"), F.sha2(text, 256).alias("sha256"))


def split_empty(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with text, and rejected rows with the reason."""
    empty = F.coalesce(F.trim(text) == "", F.lit(True))
    return df.filter(~empty), df.filter(empty).withColumn("error", F.lit("no text"))
