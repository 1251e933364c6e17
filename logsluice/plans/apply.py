"""Apply a specification to lines. Only projections: the same plan serves a table and a stream."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logsluice.functions import extract as X
from logsluice.functions.literals import sql_text
from logsluice.functions.patterns import SHIPPED_DETECTORS
from logsluice.functions.rows import bind
from logsluice.functions.timeparse import parse_time
from logsluice.operators import mapping, redaction
from logsluice.plans.spec import OnboardingSpec

_PAIR_READERS = {
    "kv": X.kv_pairs, "kv_quoted": X.kv_quoted, "kv_dialects": X.kv_dialects, "xml": X.xml_auto}
NO_SPEC = "no specification"


def _parsed_row(line: Column, spec: OnboardingSpec) -> Column:
    schema = ", ".join(f"`{f.replace('`', '``')}` string" for f in spec.fields)
    if spec.kind == "json":
        return F.from_json(line, schema)
    return F.from_csv(line, schema, {"sep": spec.separator, "quote": '"', "escape": '"'})


def extract(df: DataFrame, spec: OnboardingSpec, raw: str = "raw") -> DataFrame:
    """Add one column per field of the specification; the line is parsed once."""
    line, wanted = F.col(raw), spec.new_fields()
    if not wanted:
        return df
    if spec.kind == "pattern":
        inside = spec.message_fields()
        kept = [*wanted, "message"] if inside else wanted
        out = X.with_groups(df, spec.extraction.pattern, [n if n in kept else None for n in spec.extraction.names], raw)
        if not inside:
            return out
        pairs = X.kv_dialects(F.coalesce(F.col("message"), F.lit("")))
        out = out.withColumn("_pairs", pairs).withColumns(
            {f: X.pair_value(F.col("_pairs"), f) for f in inside}).drop("_pairs")
        return out if "message" in wanted else out.drop("message")
    if spec.kind in ("json", "csv"):
        return df.withColumn("_row", _parsed_row(line, spec)).withColumns(
            {f: F.col("_row")[f] for f in wanted}).drop("_row")
    return df.withColumn("_pairs", _PAIR_READERS[spec.kind](line)).withColumns(
        {f: X.pair_value(F.col("_pairs"), f) for f in wanted}).drop("_pairs")


def apply(
    df: DataFrame, spec: OnboardingSpec, raw: str = "raw", ingest_time: Column | None = None,
) -> DataFrame:
    """Extract, read the time, map to model names, redact the event, its fields and existing columns."""
    out = extract(df, spec, raw)
    out = out.withColumn("event_time", parse_time(
        F.col(raw), spec.time.format, spec.time.prefix, spec.time.lookahead, ingest_time))
    rules, kinds = spec.raw_rules(), dict(out.dtypes)
    texts = dict.fromkeys(f for f in [raw, *spec.fields, *spec.existing] if kinds.get(f) == "string")
    redacted = {c: redaction.redact_patterns(F.col(f"`{c}`"), rules) for c in texts} if rules else {}
    out = redaction.redact_fields(out.withColumns(redacted), spec.field_rules)
    name = mapping.rename_fields if spec.rename else mapping.alias_fields
    return name(out, list(spec.mapping))


# --- All sourcetypes of a table -----------------------------------------------------------------------
#
# What differs by sourcetype only in values (names, targets) is looked up in a map; a branch of an
# expression exists per distinct shape of rules, not per sourcetype.

_NULL_KEY = "\x00"
_DIVIDER = "\x01"


def _key(spec: OnboardingSpec) -> str:
    return _NULL_KEY if spec.sourcetype is None else spec.sourcetype


def _branches(
    sourcetype: Column, specs: Sequence[OnboardingSpec], shape: Callable[[OnboardingSpec], Hashable],
    body: Callable[[OnboardingSpec], Column], otherwise: Column,
) -> Column:
    """One branch per distinct shape, for the sourcetypes that have it."""
    groups: dict[Hashable, list[OnboardingSpec]] = {}
    for spec in specs:
        groups.setdefault(shape(spec), []).append(spec)
    chain = None
    for members in groups.values():
        test, value = sourcetype.isin([_key(m) for m in members]), body(members[0])
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return otherwise if chain is None else chain.otherwise(otherwise)


def _table(entries: dict[str, str], kind: str = "string") -> Column:
    """A literal map from text to SQL expressions of one kind."""
    if not entries:
        return F.expr(f"CAST(map() AS map<string,{kind}>)")
    return F.expr(f"map({', '.join(f'{sql_text(k)}, {v}' for k, v in entries.items())})")


def _read_pairs(line: Column, spec: OnboardingSpec) -> Column:
    """All pairs of a line that the kind of the specification can read."""
    if spec.kind == "pattern":
        values = X.group_values(line, spec.extraction.pattern, len(spec.extraction.names))
        groups = F.zip_with(
            F.array(*[F.lit(n) for n in spec.extraction.names]), values,
            lambda n, v: F.struct(n.alias("name"), X.empty_to_null(v).alias("value")))
        groups = F.filter(groups, lambda p: p["name"].isNotNull())
        if not spec.message_fields():
            return groups
        return bind(groups, lambda g: F.concat(
            g, X.kv_dialects(F.coalesce(X.pair_value(g, "message"), F.lit("")))))
    if spec.kind == "json":
        entries = F.map_entries(F.from_json(line, "map<string,string>"))
        # Of a repeated key the last value counts.
        return F.reverse(F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
    if spec.kind == "csv":
        return bind(_parsed_row(line, spec), lambda row: F.array(*[
            F.struct(F.lit(f).alias("name"), row[f].alias("value")) for f in spec.fields]))
    return _PAIR_READERS[spec.kind](line)


def _reader_shape(spec: OnboardingSpec) -> Hashable:
    if spec.kind == "pattern":
        return spec.kind, spec.extraction.pattern, spec.extraction.names, bool(spec.message_fields())
    return (spec.kind, spec.separator, tuple(spec.fields)) if spec.kind == "csv" else spec.kind


def _fields(line: Column, sourcetype: Column, specs: Sequence[OnboardingSpec]) -> Column:
    """Extracted, redacted and mapped fields of a line as a map."""
    none = F.expr("CAST(array() AS array<struct<name:string,value:string>>)")
    wanted = _table({_key(s): f"array({', '.join(map(sql_text, s.new_fields()))})" for s in specs if s.new_fields()}, "array<string>")
    names = F.try_element_at(wanted, sourcetype)
    pairs = F.coalesce(_branches(sourcetype, specs, _reader_shape, lambda s: _read_pairs(line, s), none), none)
    kept = bind(names, lambda own: X.first_per_name(F.filter(
        pairs, lambda p: p["value"].isNotNull() & F.coalesce(F.array_contains(own, p["name"]), F.lit(False)))))

    by_rule: dict[tuple[str, str], list[str]] = {}
    for spec in specs:
        for field, pattern, label in spec.field_rules:
            by_rule.setdefault((pattern, label), []).append(_key(spec) + _DIVIDER + field)

    def redacted(pair: Column) -> Column:
        value = _branches(sourcetype, specs, lambda s: tuple(s.raw_rules()),
                          lambda s: redaction.redact_patterns(pair["value"], s.raw_rules()), pair["value"])
        place = F.concat(sourcetype, F.lit(_DIVIDER), pair["name"])
        for (pattern, label), places in by_rule.items():
            value = F.when(place.isin(places), redaction.redact_patterns(value, [(pattern, label)])).otherwise(value)
        return F.struct(pair["name"].alias("name"), value.alias("value"))

    targets = {
        _key(s) + _DIVIDER + f: sql_text(f"{i:06d}{cim}")
        for s in specs for i, (f, cim) in enumerate(s.mapping) if cim and cim != f}
    if not targets:
        return F.map_from_entries(F.transform(kept, redacted))
    renaming = [_key(s) for s in specs if s.rename] or [None]

    def mapped(clean: Column) -> Column:
        def aliased(table: Column) -> Column:
            placed = F.transform(clean, lambda p: F.struct(
                F.try_element_at(table, F.concat(sourcetype, F.lit(_DIVIDER), p["name"])).alias("target"), p.alias("pair")))

            def both(every: Column) -> Column:
                found = F.array_sort(F.filter(every, lambda e: e["target"].isNotNull()))
                front = F.transform(found, lambda e: F.struct(
                    F.substring(e["target"], 7, 2 ** 31 - 1).alias("name"), e["pair"]["value"].alias("value")))
                rest = F.filter(every, lambda e: e["target"].isNull() | ~F.coalesce(sourcetype.isin(renaming), F.lit(False)))
                return X.first_per_name(F.concat(front, F.transform(rest, lambda e: e["pair"])))

            return bind(placed, both)

        return bind(_table(targets), aliased)

    return F.map_from_entries(bind(F.transform(kept, redacted), mapped))


def apply_all(
    df: DataFrame, specs: Sequence[OnboardingSpec], keys: Sequence[str], raw: str = "raw",
    default_detectors: Sequence[str] = tuple(SHIPPED_DETECTORS.split("|")),
) -> DataFrame:
    """All sourcetypes of a table in long form ``(keys, event_time, raw, fields MAP, error)``.

    One scan and one projection: a line is only touched by the rules of its own sourcetype, NULL being one.
    No line drops: one without a specification keeps its text, redacted for ``default_detectors``, has no time
    and no fields, and ``error`` says so.
    """
    line, sourcetype = F.col(raw), F.coalesce(F.col("sourcetype"), F.lit(_NULL_KEY))
    time = _branches(
        sourcetype, specs, lambda s: s.time,
        lambda s: parse_time(line, s.time.format, s.time.prefix, s.time.lookahead), F.lit(None).cast("timestamp"))
    clean = _branches(
        sourcetype, specs, lambda s: tuple(s.raw_rules()), lambda s: redaction.redact_patterns(line, s.raw_rules()),
        redaction.redact_patterns(line, redaction.detector_rules(default_detectors)))
    known = sourcetype.isin([_key(s) for s in specs]) if specs else F.lit(False)
    # Named at the end: inside a lambda ``raw`` would otherwise mean the new column of that name.
    done = df.select(
        *keys, time.alias("_0"), clean.alias("_1"), _fields(line, sourcetype, specs).alias("_2"),
        F.when(~known, NO_SPEC).alias("_3"))
    return done.toDF(*done.columns[:-4], "event_time", raw, "fields", "error")


def validate(df: DataFrame, spec: OnboardingSpec, raw: str = "raw") -> DataFrame:
    """Share of lines in which each field, and the time, was found: one row per field."""
    done = apply(df, spec, raw, F.lit(None).cast("timestamp"))
    names = [f for f in spec.new_fields() if f in done.columns] + ["event_time"]
    rates = done.agg(
        F.count("*").alias("lines"), *[F.count(f"`{n}`").alias(f"n{i}") for i, n in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"n{i}").alias("matched")) for i, n in enumerate(names)])
    return rates.select("lines", F.inline(rows)).withColumn(
        "match_rate", F.round(F.try_divide(F.col("matched").cast("double"), F.col("lines")), 4))


def match_rates(df: DataFrame, patterns: dict[str, str], raw: str = "raw") -> DataFrame:
    """Lines and share of lines that each pattern matches, in one pass over the lines."""
    counts = df.agg(F.count("*").alias("lines"), *[
        F.count_if(F.col(raw).rlike(p)).alias(f"n{i}") for i, p in enumerate(patterns.values())])
    rows = F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"n{i}").alias("matched"))
        for i, n in enumerate(patterns)])
    return counts.select("lines", F.inline(rows)).withColumn(
        "match_rate", F.round(F.try_divide(F.col("matched").cast("double"), F.col("lines")), 4))
