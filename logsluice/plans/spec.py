"""The rule specification: what one sourcetype needs to become normalised, redacted events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from logsluice.functions.patterns import CURRENT_TIME, DEFAULT_LOOKAHEAD
from logsluice.operators.redaction import custom_label, custom_rules, detector_rules, label_for
from logsluice.operators.rules import Extraction

RULE_SCHEMA = "sourcetype string, seq int, kind string, field string, pattern string, target string"


@dataclass(frozen=True)
class TimeSettings:
    """Where the event time is. ``prefix`` is a pattern; it counts only with a format."""

    format: str = CURRENT_TIME
    prefix: str = ""
    lookahead: int = DEFAULT_LOOKAHEAD

    @classmethod
    def resolve(cls, user: TimeSettings | None, detected: TimeSettings | None) -> TimeSettings:
        """The user's settings, else the detected ones, key by key."""
        user, detected = user or cls(format=""), detected or cls(format="")
        fmt = user.format or detected.format
        if not fmt or fmt == CURRENT_TIME:
            return cls()
        return cls(fmt, user.prefix or detected.prefix, user.lookahead or DEFAULT_LOOKAHEAD)


@dataclass(frozen=True)
class OnboardingSpec:
    """Rules of one sourcetype.

    ``kind`` is pattern, json, csv, kv or xml. ``fields`` lists the names to keep: for a pattern
    they are its groups, for csv the header, else the names to look up. Names of a pattern that are none of
    its groups are looked up as pairs in its ``message`` group. ``existing`` are columns the data already
    has; they are not extracted again, but redacted like the rest.
    """

    sourcetype: str | None
    kind: str
    fields: Sequence[str] = ()
    extraction: Extraction | None = None
    time: TimeSettings = TimeSettings()
    mapping: Sequence[tuple[str, str]] = ()
    rename: bool = False
    detectors: Sequence[str] = ()
    field_rules: Sequence[tuple[str, str, str]] = ()
    custom_patterns: Sequence[tuple[str, str]] = ()
    separator: str = ","
    existing: Sequence[str] = field(default=())

    def new_fields(self) -> list[str]:
        """Fields to extract: those the data does not have yet."""
        return [f for f in self.fields if f not in self.existing]

    def message_fields(self) -> list[str]:
        """Fields of a pattern that stand as pairs in its message."""
        names = self.extraction.names if self.extraction else ()
        return [f for f in self.new_fields() if f not in names] if "message" in names else []

    def raw_rules(self) -> list[tuple[str, str]]:
        """Redaction of the whole event, in order: detectors, then the user's patterns."""
        return detector_rules(list(self.detectors)) + custom_rules(self.custom_patterns)

    def rules(self) -> list[tuple[str, int, str, str, str, str]]:
        """The specification as rows ``(sourcetype, seq, kind, field, pattern, target)``."""
        rows: list[tuple[str, str, str, str]] = [("KIND", self.kind, self.separator, "rename" if self.rename else "alias")]
        if self.extraction:
            rows += [("PATTERN", str(i), self.extraction.pattern, n or "") for i, n in enumerate(self.extraction.names)]
        rows += [("EXTRACT", name, "", name) for name in self.fields]
        rows += [("EXISTING", name, "", "") for name in self.existing]
        if self.time.format != CURRENT_TIME:
            rows.append(("TIME", str(self.time.lookahead), self.time.prefix, self.time.format))
        rows += [("ALIAS", f, "", cim) for f, cim in self.mapping]
        rows += [("DETECTOR", n, p, label) for n, (p, label) in zip(
            self.detectors, detector_rules(list(self.detectors)))]
        rows += [("REDACT", f, p, label) for f, p, label in self.field_rules]
        rows += [("CUSTOM", n, p, custom_label(n)) for n, p in self.custom_patterns]
        return [(self.sourcetype, i, *row) for i, row in enumerate(rows)]


def spec_from_rules(rows: Sequence[tuple]) -> OnboardingSpec:
    """The specification that :meth:`OnboardingSpec.rules` wrote."""
    by_kind: dict[str, list[tuple[str, str, str]]] = {}
    for _, _, kind, *rest in sorted(rows, key=lambda r: r[1]):
        by_kind.setdefault(kind, []).append(tuple(rest))
    pick = lambda kind: by_kind.get(kind, [])
    kind, separator, naming = pick("KIND")[0]
    pattern = pick("PATTERN")
    times = [TimeSettings(fmt, prefix, int(ahead)) for ahead, prefix, fmt in pick("TIME")]
    return OnboardingSpec(
        sourcetype=rows[0][0], kind=kind, separator=separator, rename=naming == "rename",
        fields=[f for f, _, _ in pick("EXTRACT")], existing=[f for f, _, _ in pick("EXISTING")],
        extraction=Extraction(pattern[0][1], tuple(n or None for _, _, n in pattern)) if pattern else None,
        time=times[0] if times else TimeSettings(), mapping=[(f, cim) for f, _, cim in pick("ALIAS")],
        detectors=[n for n, _, _ in pick("DETECTOR")], field_rules=pick("REDACT"),
        custom_patterns=[(n, p) for n, p, _ in pick("CUSTOM")])


def rules_table(spark: SparkSession, specs: Sequence[OnboardingSpec]) -> DataFrame:
    """The rules of several specifications as one table."""
    return spark.createDataFrame([r for s in specs for r in s.rules()], RULE_SCHEMA)


__all__ = ["OnboardingSpec", "TimeSettings", "rules_table", "label_for"]
