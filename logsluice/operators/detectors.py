"""Detector registry: names, patterns, canonical types, selection."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, SparkSession, functions as F

from logsluice.functions.literals import lookup
from logsluice.functions.patterns import FALLBACK_DETECTOR, PII_PATTERNS
from logsluice.functions.regexlang import check_pattern, split_named_groups
from logsluice.functions.spans import Detector

log = logging.getLogger(__name__)

_GATES = {
    "IpAddressDetector": (r"\d\.\d", False),
    "EmailDetector": ("@", True),
    "CreditCardDetector": (r"\d{4}", False),
    "PhoneDetector": (r"\d{4}", False),
    "en_US.SocialSecurityNumberDetector": (r"\d{4}", False),
    "UrlDetector": ("://", True),
}

# Patterns of our own, from the public formats of these numbers and handles. Context patterns have
# two groups: what leads to the value, and the value.
_OWN = [
    Detector(
        "DateOfBirthDetector",
        r"(?i)(\b(?:dob|born|birth)[^\n]{0,30}?)"
        r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})",
        r"(?i)dob|born|birth", False, True),
    Detector("DriversLicenceDetector", r"\b[A-Z9]{5}\d{6}[A-Z9]{2}\d[A-Z]{2}\b", r"\d{6}", False),
    Detector("PostalCodeDetector", r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b", r"\d[A-Z]{2}", False),
    Detector(
        "en_GB.NationalInsuranceNumberDetector",
        r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b",
        r"\d{2} ?[A-D]", False),
    Detector(
        "en_GB.TaxReferenceNumberDetector",
        r"\b(?:\d{3}/[A-Z]{1,2}\d{1,8}|\d{5} \d{5})\b", r"\d{3}/|\d{5} ", False),
    Detector("VehicleLicencePlateDetector", r"\b[A-Z]{2}\d{2} ?[A-Z]{3}\b", r"[A-Z]\d{2}", False),
    Detector("TwitterDetector", r"(^|[^\w@.])(@\w{1,15})\b", "@", True, True),
    Detector(
        "SkypeDetector",
        r"(?i)(\bskype(?:\s*(?:id|name|handle|is|:|=))*\s*)([a-z][a-z0-9._,-]{5,31})",
        r"(?i)skype", False, True),
    Detector(
        "CredentialDetector",
        r"(?i)(\b(?:password|passwd|pass|pwd|token|secret|api_key|apikey|access_key|secret_key)"
        r"""\s*[:=]\s*["']?)([^\s"',;]{6,})""",
        r"(?i)pass|pwd|token|secret|key", False, True),
]

DETECTORS: dict[str, Detector] = {
    **{name: Detector(name, pattern, *_GATES[name]) for name, pattern in PII_PATTERNS.items()},
    **{d.name: d for d in _OWN},
}

# Detectors whose data comes from the user run as joins: a list of known values, a tagged truth.
JOIN_DETECTORS = ("UserSuppliedFilthDetector", "TaggedEvaluationFilthDetector")

CANONICAL_TYPES = {
    "IpAddressDetector": "IP_ADDRESS",
    "EmailDetector": "EMAIL",
    "CreditCardDetector": "CREDIT_CARD",
    "PhoneDetector": "PHONE_NUMBER",
    "en_US.SocialSecurityNumberDetector": "SSN",
    "UrlDetector": "URL",
    "DateOfBirthDetector": "BIRTHDATE",
    "DriversLicenceDetector": "DRIVER_LICENSE",
    "PostalCodeDetector": "LOCATION",
    "en_GB.NationalInsuranceNumberDetector": "NATIONAL_ID",
    "en_GB.TaxReferenceNumberDetector": "TAX_ID",
    "VehicleLicencePlateDetector": "LICENSE_PLATE",
    "TwitterDetector": "USERNAME",
    "SkypeDetector": "USERNAME",
    "CredentialDetector": "PASSWORD",
    "UserSuppliedFilthDetector": "OTHER",
}
_SHORT_NAMES = {
    "email": "EMAIL", "email_address": "EMAIL", "ip": "IP_ADDRESS", "phone": "PHONE_NUMBER",
    "ssn": "SSN", "us_ssn": "SSN", "credit_card": "CREDIT_CARD", "creditcard": "CREDIT_CARD",
}
# The key under which the value pattern of a canonical type is kept.
VALUE_PATTERN_KEYS = {"EMAIL": "EMAIL_ADDRESS", "SSN": "US_SSN"}


def canonical_type(type_: Column) -> Column:
    """One name per kind of data, from a detector's class, a short name, or an upper-case type."""
    return F.coalesce(
        lookup(type_, CANONICAL_TYPES), lookup(F.lower(type_), _SHORT_NAMES), F.upper(type_))


def value_pattern_key(canonical: Column) -> Column:
    return F.coalesce(lookup(canonical, VALUE_PATTERN_KEYS), canonical)


def select_detectors(selection: str | Iterable[str] | None, default: Sequence[str]) -> list[Detector]:
    """Detectors by name, from a list or a ``|`` separated text.

    Unknown names are logged and left out, so are the detectors that run as joins. If nothing
    remains the email detector is used.
    """
    if isinstance(selection, str):
        selection = [n for n in selection.split("|") if n]
    names = list(selection or default)
    chosen = []
    for name in names:
        if name in DETECTORS:
            chosen.append(DETECTORS[name])
        elif name not in JOIN_DETECTORS:
            log.warning("no detector %s", name)
    return chosen or [DETECTORS[FALLBACK_DETECTOR]]


def custom_detectors(
    patterns: Iterable[tuple[str, str]], spark: SparkSession | None = None,
) -> list[Detector]:
    """Detectors from ``(name, regex)`` pairs: any case, score 0.9, type is the upper-case name.

    Blank patterns are skipped. With a session, so are those that Spark rejects.
    """
    found = []
    for name, regex in patterns:
        if not regex or not regex.strip():
            continue
        positional, _ = split_named_groups(regex)
        if spark is not None and (reason := check_pattern(spark, positional)):
            log.warning("pattern %s skipped: %s", name, reason)
            continue
        found.append(Detector((name or "CUSTOM_PATTERN").upper(), f"(?i){positional}", score=0.9))
    return found
