"""Literal cases: sample lines, texts with personal data, custom patterns."""

import pytest
from pyspark.sql import functions as F

from logsluice.functions import extract as X
from logsluice.functions import patterns as P
from logsluice.functions import spans as S
from logsluice.functions.timeparse import parse_time
from logsluice.operators import fields, pii
from logsluice.operators.detectors import DETECTORS, canonical_type, custom_detectors, select_detectors
from logsluice.operators.formats import detect_format, detect_line_format
from logsluice.sources.lines import csv_fields, paste

APACHE = '192.168.1.100 - - [01/Jan/2024:12:00:00 +0000] "GET /index.html HTTP/1.1" 200 2326'
JSON = '{"timestamp":"2024-01-01T12:00:00Z","level":"INFO","message":"User login successful","userId":"12345"}'
CSV = "timestamp,level,component,message\n2024-01-01T12:00:00Z,INFO,AUTH,Login successful"


def one(spark, text):
    return spark.createDataFrame([(1, text)], "event_id long, raw string")


def types(spark, text, names):
    row = one(spark, text).select(S.detect_all("raw", [DETECTORS[n] for n in names]).alias("s")).first()
    return [(s["type"], s["text"], s["start"], s["end"]) for s in row["s"]]


IP, EMAIL, CARD = "IpAddressDetector", "EmailDetector", "CreditCardDetector"
PHONE, SSN, URL = "PhoneDetector", "en_US.SocialSecurityNumberDetector", "UrlDetector"


@pytest.mark.parametrize("text, detector, found", [
    ("User john.doe@example.com logged in from 192.168.1.100 at 2024-01-15 10:30:00", EMAIL, ["john.doe@example.com"]),
    ("User john.doe@example.com logged in from 192.168.1.100 at 2024-01-15 10:30:00", IP, ["192.168.1.100"]),
    ("Payment processed: 4111-1111-1111-1111, amount: $99.99", CARD, ["4111-1111-1111-1111"]),
    ("Contact us at 555-123-4567 or support@company.com", PHONE, ["555-123-4567"]),
    ("Employee ID: 123-45-6789, Department: Engineering", SSN, ["123-45-6789"]),
    ("Customer: John Smith, Email: john.smith@email.com, Phone: (555) 123-4567, IP: 10.0.0.1", PHONE, []),
    ("Customer: John Smith, Email: john.smith@email.com, Phone: (555) 123-4567, IP: 10.0.0.1", IP, ["10.0.0.1"]),
    ("Server 192.168.1.1 is responding", IP, ["192.168.1.1"]),
    ("Multiple IPs: 10.0.0.1, 172.16.0.1, and 8.8.8.8", IP, ["10.0.0.1", "172.16.0.1", "8.8.8.8"]),
    ("No IP addresses in this text", IP, []),
    ("Invalid IP: 999.999.999.999", IP, ["999.999.999.999"]),
    ("Contact me at john.doe@example.com or jane.smith@company.org", EMAIL,
     ["john.doe@example.com", "jane.smith@company.org"]),
    ("Call me at 555-123-4567 or 555.987.6543", PHONE, ["555-123-4567", "555.987.6543"]),
    ("SSN: 123-45-6789 and 987-65-4321", SSN, ["123-45-6789", "987-65-4321"]),
    ("Card: 1234-5678-9012-3456 or 1234 5678 9012 3456", CARD, ["1234-5678-9012-3456", "1234 5678 9012 3456"]),
])
def test_detectors(spark, text, detector, found):
    spans = types(spark, text, [detector])
    assert [t for _, t, _, _ in spans] == found
    assert all(text[a:b] == t for _, t, a, b in spans)


def test_offsets_are_code_points(spark):
    text = "naïve 😀 user 10.0.0.1 é"
    (_, found, start, end), = types(spark, text, [IP])
    assert text[start:end] == found == "10.0.0.1"


def test_several_detectors(spark):
    text = "Customer: john@email.com, IP: 192.168.1.1, Card: 4111-1111-1111-1111"
    assert [t for t, *_ in types(spark, text, [EMAIL, IP, CARD])] == [EMAIL, IP, CARD]


def test_custom_patterns(spark):
    chosen = custom_detectors(
        [("employee_id", r"\bEMP\d{6}\b"), ("project_code", r"\bPRJ-[A-Z]{2}\d{4}\b"), ("bad", "("), ("", " ")], spark)
    rows = pii.span_table(one(spark, "emp123456 works on PRJ-AB1234"), ["event_id"], "raw", chosen).collect()
    assert [(r["type"], r["text"], r["score"]) for r in rows] == [
        ("EMPLOYEE_ID", "emp123456", 0.9), ("PROJECT_CODE", "PRJ-AB1234", 0.9)]


def test_detector_selection():
    chosen = select_detectors(P.SHIPPED_DETECTORS, P.DEFAULT_DETECTORS)
    assert len(chosen) == 12
    assert [d.name for d in select_detectors("Nothing|TextBlobNameDetector", P.DEFAULT_DETECTORS)] == ["EmailDetector"]
    assert len(select_detectors(None, P.DEFAULT_DETECTORS)) == 15


def test_canonical_types(spark):
    rows = spark.createDataFrame([("EmailDetector",), ("email",), ("en_US.SocialSecurityNumberDetector",), ("x",)], "t string")
    assert [r[0] for r in rows.select(canonical_type(F.col("t"))).collect()] == ["EMAIL", "EMAIL", "SSN", "X"]


def test_apache_sample(spark):
    row = X.apache_common(one(spark, APACHE)).first()
    assert row["clientip"] == "192.168.1.100" and row["method"] == "GET" and row["uri"] == "/index.html"
    assert row["status"] == "200" and row["bytes"] == "2326" and row["protocol"] == "HTTP/1.1"
    assert row["timestamp"] == "01/Jan/2024:12:00:00 +0000" and row["ident"] == "-" and row["auth"] == "-"


def test_json_sample(spark):
    rows = fields.json_field_records(one(spark, JSON), ["event_id"], "raw").orderBy("pos").collect()
    assert [(r["name"], r["type"]) for r in rows] == [
        ("timestamp", "timestamp"), ("level", "string"), ("message", "string"), ("userId", "integer")]
    assert fields.json_field_records(one(spark, "[1, 2]"), ["event_id"], "raw").count() == 0
    assert fields.json_field_records(one(spark, "{broken"), ["event_id"], "raw").count() == 0


def test_csv_sample(spark):
    lines = paste(spark, CSV)
    assert lines.count() == 2
    row = lines.select(csv_fields(F.col("raw"), "timestamp string, level string, component string, message string").alias("r"))
    assert row.collect()[1]["r"]["message"] == "Login successful"


@pytest.mark.parametrize("text, wizard, line", [
    (APACHE, "apache", "apache_access"),
    (JSON, "json", "json_log"),
    ("a,b,c", "csv", "csv_log"),
    ("a=b c=d", "kv", "kv_log"),
    ("Jan 15 10:30:00 hostname message", "syslog", "sample_log"),
    ("<13>Jan 15 10:30:00 hostname message", "syslog", "sample_log"),
    ("<13>1 2024-01-15T10:30:00Z host app 1 ID1 message", "syslog", "sample_log"),
    ("<tag>value</tag>", "xml", "sample_log"),
    ('<tag attr="value" />', "xml", "kv_log"),
    ("{not json", "kv", "sample_log"),
])
def test_formats(spark, text, wizard, line):
    row = one(spark, text).select(detect_format(F.col("raw")), detect_line_format(F.col("raw"))).first()
    assert tuple(row) == (wizard, line)


@pytest.mark.parametrize("text, expected", [
    ("<tag>value</tag>", [("tag", "value")]),
    ('<tag attr="value" />', [("tag_attr", "value")]),
    ('<tag attr="value">content</tag>', [("tag_attr", "value"), ("tag", "content")]),
    ("<parent><child>value</child></parent>", [("child", "value")]),
])
def test_xml(spark, text, expected):
    row = one(spark, text).select(X.xml_auto(F.col("raw")).alias("p")).first()
    assert [(p["name"], p["value"]) for p in row["p"]] == expected


def test_kv_forms(spark):
    raw = 'a=1 b="two" c="two words" d=x=y'
    pairs = lambda f: [tuple(p) for p in one(spark, raw).select(f(F.col("raw")).alias("p")).first()["p"]]
    assert pairs(X.kv_pairs) == [("a", "1"), ("b", "two"), ("d", "x=y")]
    assert pairs(X.kv_quoted) == [("a", "1"), ("b", "two"), ("c", "two words"), ("d", "x=y")]


def test_control_characters_do_not_disturb_groups(spark):
    line = APACHE.replace("index", "in\x1fd\x1eex")
    row = X.apache_common(one(spark, line)).first()
    assert row["uri"] == "/in\x1fd\x1eex.html" and row["bytes"] == "2326"


def test_duplicate_json_keys(spark):
    rows = fields.json_field_records(one(spark, '{"a":1,"b":2,"a":3}'), ["event_id"], "raw").collect()
    assert {r["name"]: r["value"] for r in rows} == {"a": "3", "b": "2"}


def test_leap_day_without_year(spark):
    df = spark.createDataFrame([("Feb 29 10:00:00", "2025-01-05 00:00:00"), ("Dec 31 23:59:00", "2025-01-01 00:01:00")],
                               "raw string, t string")
    out = df.select(parse_time(F.col("raw"), "%b %d %H:%M:%S", ingest_time=F.col("t").cast("timestamp")).cast("string"))
    assert [r[0] for r in out.collect()] == ["2024-02-29 10:00:00", "2024-12-31 23:59:00"]


def test_suggestion_text(spark):
    df = one(spark, "a@b.com and 10.0.0.1")
    text = df.select(pii.suggestion(S.detect_all("raw", [DETECTORS[EMAIL], DETECTORS[IP]]))).first()[0]
    assert text.startswith("Detected PII types: EmailDetector, IpAddressDetector. Recommended action")


def test_time_settings_fall_back_key_by_key():
    from logsluice.plans.spec import TimeSettings

    detected = TimeSettings("%Y-%m-%d %H:%M:%S", "at ", 40)
    assert TimeSettings.resolve(None, detected) == TimeSettings("%Y-%m-%d %H:%M:%S", "at ", 25)
    user = TimeSettings("%b %d %H:%M:%S", "", 15)
    assert TimeSettings.resolve(user, detected) == TimeSettings("%b %d %H:%M:%S", "at ", 15)
    assert TimeSettings.resolve(None, None) == TimeSettings("CURRENT_TIME", "", 25)
    assert TimeSettings.resolve(TimeSettings("", "x", 9), None) == TimeSettings()


def test_field_rules():
    from logsluice.operators.redaction import field_rule

    assert field_rule("a", "email", "a=b@c.de")[0].startswith("a=(")
    assert field_rule("a", "ssn", '{"a":"123-45-6789"}') == (
        r'"a"\s*:\s*"(\d{3}-\d{2}-\d{4})"', '"a":"[REDACTED_SSN]"')
    assert field_rule("request", "x", APACHE) == (r'"([^\s,="]+)"', '"[REDACTED_X]"')
    assert field_rule("b", "phone", "a,b\n1,2") == (r"\d{3}-\d{3}-\d{4}", "[REDACTED_PHONE]")
    assert field_rule(None, None, "x") == (r"[^\s]+", "[REDACTED_PII]")
