"""Relations that hold for any text: offsets, redaction, merging, upsert, batch and stream."""

import random
import re

from pyspark.sql import functions as F

from logsluice.functions import spans as S
from logsluice.operators import fields, pii, redaction
from logsluice.operators.detectors import DETECTORS
from logsluice.plans import apply as A
from logsluice.plans.queries_rules import KV_SPEC
from logsluice.sources import rendered as R
from logsluice.sources.tables import table
from logsluice.streaming import onboard as SO

NAMES = ["IpAddressDetector", "EmailDetector", "CreditCardDetector", "PhoneDetector",
         "en_US.SocialSecurityNumberDetector", "UrlDetector", "CredentialDetector"]
CHOSEN = [DETECTORS[n] for n in NAMES]
PIECES = ["10.0.0.1", "1.2.3.4.5", "a@b.co", "x.y@z.example.org", "4111 1111 1111 1111", "555-123-4567",
          "123-45-6789", "123456789", "https://e.x/y?a=1", "token = \"abcdef123\"", "pwd=secret99", " ", "\n", ",",
          "é", "ß", "word", "=", "\"", "😀", "..", "-", "$1", "\\", "[x]", "user=bob"]


def texts(count=400, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(count)]


def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id long, raw string").repartition(8)


def brute(text):
    """Spans by Python's own matcher; Java's word boundary knows all letters, \\w only ASCII ones."""
    out = []
    for i, d in enumerate(CHOSEN):
        pattern = d.pattern.replace(r"\w", "[a-zA-Z0-9_]").replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]")
        pattern = pattern.replace(r"[^[ \t\n\x0b\f\r]", r"[^ \t\n\x0b\f\r")
        for m in re.finditer(pattern.replace("[[ \\t\\n\\x0b\\f\\r]-]", "[ \\t\\n\\x0b\\f\\r-]"), text):
            value, start = (m[2], m.start(2)) if d.in_context else (m[0], m.start())
            if len(value.strip(" ")) >= 3:
                out.append((start, start + len(value), i, d.name, value))
    return sorted(out)


def test_spans_equal_brute_force(spark):
    rows = frame(spark).select("raw", S.detect_all("raw", CHOSEN).alias("s")).collect()
    found = 0
    for r in rows:
        mine = [(s["start"], s["end"], s["ord"], s["type"], s["text"]) for s in r["s"]]
        assert mine == brute(r["raw"]), r["raw"]
        assert all(r["raw"][a:b] == t for a, b, _, _, t in mine)
        found += len(mine)
    assert found > 500


def test_islands_and_redaction_equal_brute_force(spark):
    out = redaction.redact_spans(frame(spark), "raw", CHOSEN).collect()
    from logsluice.operators.detectors import CANONICAL_TYPES

    for r in out:
        text, expected, at = r["raw"], "", 0
        isles = []
        for start, end, _, type_, _ in brute(text):
            if isles and start < isles[-1][1]:
                isles[-1][1] = max(isles[-1][1], end)
            else:
                isles.append([start, end, type_])
        for start, end, type_ in isles:
            expected += text[at:start] + f"[REDACTED_{CANONICAL_TYPES[type_]}]"
            at = end
        assert r["redacted"] == expected + text[at:]


def test_nothing_is_left_and_redaction_is_idempotent(spark):
    once = redaction.redact_spans(frame(spark), "raw", CHOSEN)
    assert all(r["items"] == 0 for r in redaction.residual(once, "redacted", CHOSEN).collect())
    rules = redaction.detector_rules(NAMES[:6])
    first = redaction.redact_patterns(F.col("raw"), rules)
    twice = redaction.redact_patterns(first, rules)
    assert frame(spark).filter(first != twice).count() == 0


def test_counts_equal_spans(spark):
    counts = {r["type"]: r["items"] for r in pii.type_counts(frame(spark), "raw", CHOSEN).collect()}
    spans = {r["type"]: r["count"] for r in pii.span_table(
        frame(spark), ["id"], "raw", CHOSEN).groupBy("type").count().collect()}
    assert {k: v for k, v in counts.items() if v} == spans


def test_parts_on_separate_lines_are_found_together(spark):
    a, b = "mail a@b.example.com", "from 10.0.0.1"
    df = spark.createDataFrame([(a,), (b,), (a + "\n" + b,)], "raw string")
    found = [[s["text"] for s in r[0]] for r in df.select(S.detect_all("raw", CHOSEN)).collect()]
    assert found[2] == found[0] + found[1]


def test_overlaps_equal_all_pairs(spark):
    spans = pii.span_table(frame(spark), ["id"], "raw", CHOSEN)
    by_doc = {}
    for r in spans.collect():
        by_doc.setdefault(r["id"], []).append((r["start"], r["end"], r["ord"]))
    expected = sum(
        1 for ss in by_doc.values() for x in ss for y in ss if x < y and x[0] < y[1] and y[0] < x[1])
    assert pii.overlaps(spans, "id").count() == expected > 0


def test_upsert_twice_is_once(spark):
    schema = "name string, value string, source string"
    old = spark.createDataFrame([("a", "1", "auto_detect"), ("b", "2", "custom_regex")], schema)
    new = spark.createDataFrame([("c", "3", "custom_regex")], schema)
    once = fields.upsert_source(old, new, "custom_regex")
    twice = fields.upsert_source(once, new, "custom_regex")
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", "1", "auto_detect"), ("c", "3", "custom_regex")]


def test_stream_equals_batch(spark, folder):
    lines = lambda events: R.with_typed_values(events).select("event_id", R.kv_line().alias("raw"))
    batch = A.apply(lines(table(spark, folder, "events")), KV_SPEC)
    stream = SO.run_to_table(spark, A.apply(lines(SO.stream_table(spark, folder, "events")), KV_SPEC), "test")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
