"""Queries that redact, and that check what is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.functions import patterns as P
from logsluice.operators import pii, redaction
from logsluice.operators.detectors import DETECTORS
from logsluice.plans import oracle_text as O
from logsluice.plans.queries_pii import CONTACT_SET, DOCUMENT_SET, EMAIL, IP, CARD, PHONE, SSN
from logsluice.plans.registry import query
from logsluice.sources.rendered import customer_contacts, customer_notes
from logsluice.sources.tables import table

_PATTERN_SET = [IP, EMAIL, CARD]
CUSTOM = [("hex token", r"[0-9a-f]{32,}"), ("mail $ host", r"@mail(?<n>\d)\.example"), ("", "  ")]


def _chain(column: str, rules) -> str:
    for pattern, label in rules:
        column = f"regexp_replace({column}, {O.lit(pattern)}, {O.lit(label)}, 'g')"
    return column


def _sql_patterns(column: str) -> str:
    return _chain(column, redaction.detector_rules(_PATTERN_SET))


# Non-overlapping spans: gaps and labels alternate, from the offsets of every span of a document.
_REBUILT = f"""
WITH s AS ({O.canonical(O.spans("documents", ["doc_id", "text AS body"], "text", [IP, EMAIL]))}),
o AS (SELECT *, coalesce(lag(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), 0) AS prev FROM s),
r AS (SELECT doc_id, string_agg(substr(body, prev + 1, start_pos - prev) || '[REDACTED_' || canonical || ']', ''
    ORDER BY start_pos) || substr(any_value(body), max(end_pos) + 1) AS redacted FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.redacted, d.text) AS redacted FROM documents d LEFT JOIN r USING (doc_id)"""


@query("redact_spans", _REBUILT)
def redact_spans(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return redaction.redact_spans(
        docs, "text", [DETECTORS[IP], DETECTORS[EMAIL]]).select("doc_id", "redacted")


# Card numbers hold no social security or phone number inside word boundaries once merged, so the
# expected line follows from its typed values.
@query("redact_spans_contacts", f"""
SELECT c_custkey, CASE c_custkey % 3
  WHEN 0 THEN 'mail=[REDACTED_EMAIL] addr=[REDACTED_IP_ADDRESS] tel=[REDACTED_PHONE_NUMBER] seg='||c_mktsegment
  WHEN 1 THEN '{{"ssn":"[REDACTED_SSN]","card":"[REDACTED_CREDIT_CARD]","seg":"'||c_mktsegment||'"}}'
  ELSE '[REDACTED_IP_ADDRESS] - - [01/Jan/2024:12:00:00 +0000] "GET /?m=x HTTP/1.1" 200 12 [REDACTED_EMAIL]'
  END AS redacted FROM customer""")
def redact_spans_contacts(spark, folder):
    lines = customer_contacts(spark, folder).select("c_custkey", "raw")
    return redaction.redact_spans(
        lines, "raw", [DETECTORS[d] for d in CONTACT_SET]).select("c_custkey", "redacted")


@query("redact_patterns", f"SELECT doc_id, {_sql_patterns('text')} AS redacted FROM documents")
def redact_patterns(spark, folder):
    return table(spark, folder, "documents").select("doc_id", redaction.redact_patterns(
        F.col("text"), redaction.detector_rules(_PATTERN_SET)).alias("redacted"))


@query("redact_one_pass", f"SELECT doc_id, {_sql_patterns('text')} AS redacted FROM documents")
def redact_one_pass(spark, folder):
    """The same text from one scan; in the documents no two detectors' matches touch."""
    return table(spark, folder, "documents").select(
        "doc_id", redaction.redact_detectors(F.col("text"), _PATTERN_SET).alias("redacted"))


_FIELD_RULES = [
    ("url", r"[?&]page=\d+", "[REDACTED_PAGE]"),
    ("url", P.REDACTION_PATTERNS["UrlDetector"], "[REDACTED_URL]"),
    ("absent", "x", "[REDACTED_X]")]


@query("redact_fields", f"""
SELECT page_id, {_chain('url', [(p, r) for f, p, r in _FIELD_RULES if f == 'url'])} AS url,
  length(html) AS html_chars FROM pages""")
def redact_fields(spark, folder):
    return redaction.redact_fields(table(spark, folder, "pages"), _FIELD_RULES).select(
        "page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@query("redact_map_fields", """
SELECT event_id, '[REDACTED_USER]' AS login, '[REDACTED_EMAIL] x' AS email, event_type AS kind FROM events""")
def redact_map_fields(spark, folder):
    from logsluice.sources.rendered import text, typed_events

    fields = F.create_map(
        F.lit("login"), F.col("login"), F.lit("email"), text(F.col("email"), " x"),
        F.lit("kind"), F.col("event_type"))
    events = typed_events(spark, folder).select("event_id", redaction.redact_map_fields(
        fields, [("login", r"user\d+", "[REDACTED_USER]"),
                 ("email", P.REDACTION_PATTERNS[EMAIL], "[REDACTED_EMAIL]")]).alias("m"))
    return events.select("event_id", *[F.col("m")[k].alias(k) for k in ("login", "email", "kind")])


@query("redact_custom", f"""
SELECT doc_id, {_chain('text', [(r'[0-9a-f]{32,}', '[REDACTED_HEX_TOKEN]'),
                                (r'@mail(\d)\.example', '[REDACTED_MAIL_$_HOST]')])} AS redacted
FROM documents""")
def redact_custom(spark, folder):
    return table(spark, folder, "documents").select("doc_id", redaction.redact_patterns(
        F.col("text"), redaction.custom_rules(CUSTOM)).alias("redacted"))


@query("redact_field_rules", f"""
SELECT c_custkey, CASE c_custkey % 3
  WHEN 0 THEN 'mail=[REDACTED_EMAIL] addr='||ip||' tel=[REDACTED_PHONE] seg='||c_mktsegment
  WHEN 1 THEN '{{"ssn":"[REDACTED_SSN]","card":"'||card||'","seg":"'||c_mktsegment||'"}}'
  ELSE '[REDACTED_IP] - - [01/Jan/2024:12:00:00 +0000] "GET /?m=x HTTP/1.1" 200 12 '||email END AS redacted
FROM ({O.CONTACTS})""")
def redact_field_rules(spark, folder):
    """Rules made from one sample line per shape, applied to the lines of that shape."""
    shapes = [
        ("mail=a@b.co addr=1.2.3.4 tel=555-000-0000 seg=X", [("mail", "email"), ("tel", "phone")]),
        ('{"ssn":"123-45-6789","card":"1","seg":"X"}', [("ssn", "ssn")]),
        ('1.2.3.4 - - [01/Jan/2024:12:00:00] "GET / HTTP/1.1" 200 12',
         [("clientip", "ip")])]
    rules = [[redaction.field_rule(f, t, sample) for f, t in fields] for sample, fields in shapes]
    line, turn = F.col("raw"), F.col("c_custkey") % 3
    redacted = F.when(turn == 0, redaction.redact_patterns(line, rules[0])).when(
        turn == 1, redaction.redact_patterns(line, rules[1])).otherwise(
        redaction.redact_patterns(line, rules[2]))
    return customer_contacts(spark, folder).select("c_custkey", redacted.alias("redacted"))


# By the pair nearest to the left edge of the surroundings, by JSON key, by position.
_EMAIL_VALUE = P.VALUE_PATTERNS["EMAIL_ADDRESS"]


_PHONE_VALUE = P.VALUE_PATTERNS["PHONE_NUMBER"]


@query("redact_context", f"""
WITH c AS ({O.CONTACTS}),
p AS (SELECT *, strpos(raw, phone) - 1 AS pos FROM c),
k AS (SELECT *, regexp_extract(substr(raw, greatest(pos - 50, 0) + 1, pos + length(phone) + 50 - greatest(pos - 50, 0)),
  {O.lit(P.KV_KEY)}, 1) AS key FROM p)
SELECT c_custkey, CASE c_custkey % 3
  WHEN 0 THEN regexp_replace(
    regexp_replace(raw, {O.lit('mail=' + _EMAIL_VALUE)}, 'mail=[REDACTED_EMAIL_ADDRESS]', 'g'),
    key || {O.lit('=(' + _PHONE_VALUE + ')')}, key || '=[REDACTED_PHONE_NUMBER]', 'g')
  WHEN 1 THEN '{{"ssn":"[REDACTED_US_SSN]","card":"'||card||'","seg":"'||c_mktsegment||'"}}'
  ELSE raw END AS redacted FROM k""")
def redact_context(spark, folder):
    lines = customer_contacts(spark, folder).select("c_custkey", "raw")
    names = [EMAIL, PHONE, SSN]
    return redaction.redact_in_context(
        lines, "raw", [DETECTORS[n] for n in names], fallback=False).select("c_custkey", "redacted")


@query("redact_context_whole", "SELECT c_custkey, false AS leaks FROM customer")
def redact_context_whole(spark, folder):
    """With the fallback nothing that was found is left in the line."""
    lines = customer_contacts(spark, folder)
    done = redaction.redact_in_context(lines, "raw", [DETECTORS[n] for n in (EMAIL, PHONE, SSN)])
    values = [F.col("redacted").contains(F.col(c)) for c in ("email", "phone", "ssn")]
    return done.select("c_custkey", (values[0] | values[1] | values[2]).alias("leaks"))


_NOTE_TYPES = {
    "DateOfBirthDetector": "BIRTHDATE", "DriversLicenceDetector": "DRIVER_LICENSE", "PostalCodeDetector": "LOCATION",
    "en_GB.NationalInsuranceNumberDetector": "NATIONAL_ID", "en_GB.TaxReferenceNumberDetector": "TAX_ID",
    "VehicleLicencePlateDetector": "LICENSE_PLATE", "TwitterDetector": "USERNAME", "SkypeDetector": "USERNAME",
    "CredentialDetector": "PASSWORD"}


@query("redact_rules_of_all_detectors", """
SELECT c_custkey, c_name||' born [REDACTED_BIRTHDATE], licence [REDACTED_DRIVER_LICENSE], code [REDACTED_LOCATION], number '
  ||'[REDACTED_NATIONAL_ID], ref [REDACTED_TAX_ID], plate [REDACTED_LICENSE_PLATE], by [REDACTED_USERNAME] skype: '
  ||'[REDACTED_USERNAME] password=[REDACTED_PASSWORD]' AS redacted FROM customer""")
def redact_rules_of_all_detectors(spark, folder):
    """Pattern rules of the detectors without a redaction pattern of their own; context stays."""
    rules = redaction.detector_rules(list(_NOTE_TYPES))
    return customer_notes(spark, folder).select(
        "c_custkey", redaction.redact_patterns(F.col("note"), rules).alias("redacted"))


_CTX = O.infer_field(O.canonical(O.spans(
    "documents", ["doc_id", "text AS body"], "text", [EMAIL, IP])), "body")


@query("redact_context_docs", f"""
WITH s AS (SELECT doc_id, start_pos, ord, body, regexp_extract(ctx, {O.lit(P.KV_KEY)}, 1) AS kv,
    CASE type WHEN '{EMAIL}' THEN 'EMAIL_ADDRESS' ELSE 'IP_ADDRESS' END AS t,
    CASE type WHEN '{EMAIL}' THEN {O.lit(_EMAIL_VALUE)} ELSE {O.lit(P.VALUE_PATTERNS['IP_ADDRESS'])} END AS v
  FROM ({_CTX})),
r AS (SELECT doc_id, any_value(body) AS body, list_distinct(list(CASE WHEN kv <> '' THEN kv||'='||v ELSE v END)) AS p
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce({_chain("r.body", [])}, d.text) IS NOT NULL AS present,
  CASE WHEN r.doc_id IS NULL THEN d.text
  ELSE regexp_replace(regexp_replace(r.body, {O.lit(_EMAIL_VALUE)}, '[REDACTED_EMAIL_ADDRESS]', 'g'),
    {O.lit(P.VALUE_PATTERNS['IP_ADDRESS'])}, '[REDACTED_IP_ADDRESS]', 'g') END AS redacted
FROM documents d LEFT JOIN r USING (doc_id)""")
def redact_context_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return redaction.redact_in_context(docs, "text", [DETECTORS[EMAIL], DETECTORS[IP]], fallback=False).select(
        "doc_id", F.lit(True).alias("present"), "redacted")


@query("text_fingerprint", """
SELECT doc_id, length(text) AS length, sha256(text) AS sha256 FROM documents""")
def text_fingerprint(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", redaction.text_fingerprint(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("redact_residual", " UNION ALL ".join(
    f"SELECT '{d}' AS type, 0::BIGINT AS items" for d in DOCUMENT_SET))
def redact_residual(spark, folder):
    redacted = redaction.redact_spans(
        table(spark, folder, "documents").select("text"), "text", [DETECTORS[d] for d in DOCUMENT_SET])
    return redaction.residual(redacted, "redacted", [DETECTORS[d] for d in DOCUMENT_SET])


@query("reject_empty", """
SELECT page_id, 'no text' AS error FROM pages WHERE trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) = ''
UNION ALL SELECT page_id, NULL FROM pages WHERE trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> ''""")
def reject_empty(spark, folder):
    titled = table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("raw"))
    kept, rejected = redaction.split_empty(titled, F.col("raw"))
    return rejected.select("page_id", "error").unionByName(
        kept.select("page_id", F.lit(None).cast("string").alias("error")))
