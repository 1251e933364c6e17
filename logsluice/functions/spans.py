"""Spans of personal data: detection with offsets, choice, merging, replacement.

Offsets are code points, from 0, end exclusive. A document's spans are an array column of that
document, so choosing, merging and redacting need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from logsluice.functions import patterns as P
from logsluice.functions.literals import lookup, sql_text
from logsluice.functions.rows import bind, cut_blocks, running, running_sql, text_blocks

SPAN_TYPE = "struct<start:int,end:int,ord:int,type:string,text:string,score:double>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
ISLANDS_TYPE = "array<struct<start:int,end:int,type:string,spans:int>>"
MIN_SPAN_CHARS = 3


@dataclass(frozen=True)
class Detector:
    """A regular expression detector.

    ``gate`` is a cheap pattern or literal that every match contains. With ``in_context`` the
    pattern has two groups, context and value, and only the value is the span.
    """

    name: str
    pattern: str
    gate: str | None = None
    gate_is_literal: bool = True
    in_context: bool = False
    score: float = 1.0

    def may_match(self, text: Column) -> Column:
        if self.gate is None:
            return text.rlike(self.pattern)
        cheap = text.contains(self.gate) if self.gate_is_literal else text.rlike(self.gate)
        return cheap & text.rlike(self.pattern)


# Noncharacters that set matches apart from the text between them.
_OPEN, _GROUP, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


# No match, an empty one in particular, may start between the halves of a surrogate pair.
_WHOLE_START = r"(?![\uDC00-\uDFFF])"
# Characters for which a text can't be searched as it is: marks, and those that are surrogate pairs.
_RARE = rf"'[{_OPEN}-{_CLOSE}\\x{{10000}}-\\x{{10FFFF}}]'"


def detect_sql(text: str, detector: Detector, order: int) -> str:
    """SQL for the spans of one detector in an expression, see :func:`spans_sql`."""
    pattern = f"(?:{detector.pattern})"
    plain, whole = sql_text(pattern), sql_text(_WHOLE_START + pattern)
    gate = f"{text} RLIKE {plain}"
    if detector.gate is not None:
        cheap = sql_text(detector.gate)
        gate = (f"contains({text}, {cheap})" if detector.gate_is_literal else f"{text} RLIKE {cheap}") + f" AND {gate}"
    return spans_sql(text, plain, whole, gate, str(order), sql_text(detector.name), f"{detector.score}D", detector.in_context)


def spans_sql(
    text: str, plain: str, whole: str, gate: str, order: str, type_: str, score: str, in_context: bool = False,
) -> str:
    """SQL for the spans of a pattern; all arguments are SQL, so they may differ from row to row.

    One replacement marks every match where it stands, a split takes matches and gaps apart, and running
    totals of their lengths give the offsets.

    Matches, empty ones too, are those of a single run of the pattern over the whole text, so anchors
    and lookarounds see what they should. Marks that a text already holds count as U+FFFD. ``whole`` is the
    pattern that starts at no second half of a surrogate pair; texts without pairs do with ``plain``.
    """
    clean = (
        f"CASE WHEN {text} RLIKE '[{_OPEN}-{_CLOSE}]' "
        f"THEN translate({text}, '{_OPEN}{_GROUP}{_CLOSE}', '\ufffd\ufffd\ufffd') ELSE {text} END")
    groups = f"$1{_GROUP}$2{_GROUP}$0" if in_context else "$0"
    marked = (
        f"CASE WHEN octet_length({text}) > length({text}) AND {text} RLIKE {_RARE} "
        f"THEN regexp_replace({clean}, {whole}, '{_OPEN}{groups}{_CLOSE}') "
        f"ELSE regexp_replace({text}, {plain}, '{_OPEN}{groups}{_CLOSE}') END")
    part = (lambda i: f"substring_index(substring_index(m, '{_GROUP}', {i + 1}), '{_GROUP}', -1)")
    rest = part(2) if in_context else "m"
    lead, value = (f"length({part(0)})", part(1)) if in_context else ("0", f"substring_index(m, '{_CLOSE}', 1)")
    hits = (
        f"transform(slice(pieces, 2, size(pieces) - 1), m -> named_struct('lead', {lead}, 'text', {value}, "
        f"'both', length({rest}) - 1))")
    begin = "length(pieces[0]) + ends[n] - h.both + h.lead"
    span = (
        f"named_struct('start', {begin}, 'end', {begin} + length(h.text), 'ord', {order}, "
        f"'type', {type_}, 'text', h.text, 'score', {score})")
    return f"""CASE WHEN {gate} THEN
        transform(array(split({marked}, '{_OPEN}')), pieces ->
          transform(array({hits}), hits ->
            transform(array({running_sql("transform(hits, h -> h.both)")}), ends ->
              filter(transform(hits, (h, n) -> {span}), s -> length(trim(s.text)) >= {MIN_SPAN_CHARS}))[0])[0])[0]
        ELSE CAST(array() AS {SPANS_TYPE}) END"""


def detect_by(text: str, pattern: str, order: str, type_: str, score: str) -> Column:
    """Spans of a pattern that is itself a column, as are its order, type and score."""
    plain, whole = (f"concat({sql_text(start + '(?:')}, `{pattern}`, ')')" for start in ("", _WHOLE_START))
    return F.expr(spans_sql(f"`{text}`", plain, whole, f"`{text}` RLIKE {plain}", f"`{order}`", f"`{type_}`", f"`{score}`"))


def detect(text: str, detector: Detector, order: int = 0) -> Column:
    """All spans of one detector in the named column.

    Texts without a match stop at the gate or at the first failed scan.
    """
    return F.expr(detect_sql(f"`{text}`", detector, order))


def detect_all(text: str, detectors: Sequence[Detector]) -> Column:
    """Spans of several detectors, by position; detectors do not see each other."""
    found = [detect_sql(f"`{text}`", d, i) for i, d in enumerate(detectors)]
    return F.expr(f"sort_array(concat({', '.join(found)}))" if len(found) > 1 else found[0])


def count_matches(text: Column, detector: Detector) -> Column:
    """Number of spans without offsets."""
    group = F.lit(2 if detector.in_context else 0)
    found = F.regexp_extract_all(text, F.lit(detector.pattern), group)
    kept = F.filter(found, lambda m: F.length(F.trim(m)) >= MIN_SPAN_CHARS)
    return F.when(detector.may_match(text), F.size(kept)).otherwise(F.lit(0))


def _by_position_then_score(spans: Column) -> Column:
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), (-s["score"]).alias("loss"),
        s["ord"].alias("ord"), s.alias("span"))))
    return F.transform(keyed, lambda k: k["span"])


def best_per_position(spans: Column) -> Column:
    """Of spans at the same place keep the highest score, the earlier detector on a tie."""
    def first_at_place(every: Column) -> Column:
        def differs(span: Column, i: Column) -> Column:
            last = F.get(every, i - 1)
            return (i == 0) | (last["start"] != span["start"]) | (last["end"] != span["end"])

        return F.filter(every, differs)

    return bind(_by_position_then_score(spans), first_at_place)


def merge_overlaps(spans: Column) -> Column:
    """Overlapping spans as maximal islands; an island takes the type of its leading span.

    The leading span starts first; among equals the shorter sorts first, then the earlier detector.
    Expects spans sorted by position.
    """
    def islands(parts: Column) -> Column:
        every, reach = parts["spans"], parts["reach"]
        leads = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: (
            i == 0) | (F.get(every, i)["start"] >= F.get(reach, i - 1)))

        def build(first: Column) -> Column:
            def one(lead: Column, n: Column) -> Column:
                following = F.coalesce(F.get(first, n + 1), F.size(every))
                span = F.get(every, lead)
                return F.struct(
                    span["start"].alias("start"), F.get(reach, following - 1).alias("end"), span["type"].alias("type"),
                    (following - lead).alias("spans"))

            return F.transform(first, one)

        return bind(leads, build)

    reach = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    return F.when(F.size(spans) > 0, bind(F.struct(spans.alias("spans"), reach.alias("reach")), islands)).otherwise(
        F.array().cast(ISLANDS_TYPE))


def redaction_label(type_: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), type_, F.lit("]"))


def replace_islands(text: Column, islands: Column, label) -> Column:
    """Rebuild the text with each island replaced by ``label(type)``; linear in the text."""
    def rebuild(parts: Column) -> Column:
        blocks, isles = parts["blocks"], parts["isles"]
        before = F.transform(isles, lambda isle, i: F.concat(
            cut_blocks(blocks, F.coalesce(F.get(isles, i - 1)["end"], F.lit(0)), isle["start"]), label(isle["type"])))
        tail = cut_blocks(blocks, F.element_at(isles, -1)["end"], parts["size"])
        return F.concat(F.array_join(before, ""), tail)

    whole = F.struct(text_blocks(text).alias("blocks"), islands.alias("isles"), F.length(text).alias("size"))
    return F.when(F.size(islands) > 0, bind(whole, rebuild)).otherwise(text)


# --- Field and pattern of a span from its surroundings ------------------------------------------

def context_of(text: Column, start: Column, end: Column) -> Column:
    """The span with up to 50 characters on each side."""
    first = F.greatest(start - P.CONTEXT_CHARS, F.lit(0))
    return F.substring(text, first + 1, end + P.CONTEXT_CHARS - first)


def infer_field(access: Column, context: Column, start: Column, type_: Column) -> Column:
    """Field name of a span: the first ``k=`` in its context, else ``"k":"``, else, in an access log line,
    its place, else its type in lower case."""
    kv = F.nullif(F.regexp_extract(context, P.KV_KEY, 1), F.lit(""))
    json = F.nullif(F.regexp_extract(context, P.JSON_KEY, 1), F.lit(""))
    positional = F.when(
        access,
        F.when(start < P.POSITIONAL_START, "clientip")
        .when(context.contains("[") & context.contains("]"), "timestamp")
        .when(context.contains('"'), "request"))
    return F.coalesce(kv, json, positional, F.lower(type_))


def nearest_field(access: Column, context: Column, start: Column, type_: Column) -> Column:
    """Like :func:`infer_field`, with the last ``k=`` in front of the span instead of the first."""
    before = F.substring(context, F.lit(1), F.least(start, F.lit(P.CONTEXT_CHARS)))
    nearest = F.nullif(
        F.regexp_extract(before, r"^[\s\S]*?(?:[\s\S]*[^\p{L}\p{N}_])?" + P.KV_KEY, 1), F.lit(""))
    return F.coalesce(nearest, infer_field(access, context, start, type_))


def value_pattern(type_: Column) -> Column:
    """The pattern of values of a type."""
    return F.coalesce(lookup(type_, P.VALUE_PATTERNS), F.lit(P.DEFAULT_VALUE_PATTERN))


def escaped(text: Column) -> Column:
    """Text with a backslash before each character that is special in a pattern."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def redaction_pattern(type_: Column, text: Column) -> Column:
    """The pattern that redacts data of a detector's type, else the text itself, escaped."""
    return F.coalesce(lookup(type_, P.REDACTION_PATTERNS), escaped(text))


def context_rule(text: Column, start: Column, end: Column, type_: Column, found: Column) -> Column:
    """``struct(pattern, replacement)`` that redacts one span by the form of the line around it.

    ``replacement`` is literal text. Applying it takes care of ``$`` and backslash.
    """
    lit, label = F.lit, redaction_label(F.upper(type_))

    def rule(pattern: Column, replacement: Column) -> Column:
        return F.struct(pattern.alias("pattern"), replacement.alias("replacement"))

    def choose(parts: Column) -> Column:
        context, kv, json, value = (parts[k] for k in ("context", "kv", "json", "value"))
        positional = (
            F.when(start < P.POSITIONAL_START, rule(F.concat(lit("^("), value, lit(")")), label))
            .when(context.contains("[") & context.contains("]"), rule(
                F.concat(lit(r"\[("), value, lit(r")\]")), F.concat(lit("["), label, lit("]"))))
            .when(context.contains('"'), rule(
                F.concat(lit('"([^"]*'), escaped(found), lit('[^"]*)"')),
                F.concat(lit('"'), label, lit('"'))))
            .otherwise(rule(value, label)))
        return (
            F.when(kv != "", rule(
                F.concat(kv, lit("=("), value, lit(")")), F.concat(kv, lit("="), label)))
            .when(json != "", rule(
                F.concat(lit('"'), json, lit(r'"\s*:\s*"('), value, lit(')"')),
                F.concat(lit('"'), json, lit('":"'), label, lit('"'))))
            .when(text.rlike(P.LEADING_IP), positional)
            .otherwise(rule(value, label)))

    return bind(context_of(text, start, end), lambda c: bind(
        F.struct(
            c.alias("context"), F.regexp_extract(c, P.KV_KEY, 1).alias("kv"),
            F.regexp_extract(c, P.JSON_KEY, 1).alias("json"), value_pattern(type_).alias("value")),
        choose))


def apply_rules(text: Column, rules: Column) -> Column:
    """Replace all matches of each rule in turn; ``rules`` is an array of pattern and replacement."""
    return F.aggregate(
        rules, text,
        lambda acc, r: F.regexp_replace(
            acc, r["pattern"], F.regexp_replace(r["replacement"], r"([\\$])", r"\\$1")))
