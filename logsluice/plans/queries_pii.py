"""Queries over spans of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsluice.functions import patterns as P
from logsluice.functions import spans as S
from logsluice.functions.rows import bind, cut_blocks, each, text_blocks
from logsluice.operators import pattern_table, pii, redaction
from logsluice.operators.detectors import (
    DETECTORS, canonical_type, custom_detectors, select_detectors,
)
from logsluice.plans import oracle_text as O
from logsluice.plans.registry import query
from logsluice.sources import rendered as R
from logsluice.sources.rendered import customer_contacts, customer_notes
from logsluice.sources.tables import table

IP, EMAIL, CARD, CREDENTIAL = (
    "IpAddressDetector", "EmailDetector", "CreditCardDetector", "CredentialDetector")
PHONE, SSN, URL = "PhoneDetector", "en_US.SocialSecurityNumberDetector", "UrlDetector"
DOCUMENT_SET = [IP, EMAIL, CARD, CREDENTIAL]
CONTACT_SET = [IP, EMAIL, CARD, PHONE, SSN, URL]
CUSTOM = [("employee mail", r"\b(?P<who>[a-z]+)\.\d{2}@mail\d\.example\.com"),
          ("hex token", r"[0-9a-f]{32,}"), ("blank", " "), ("broken", "(unclosed")]
NOTE_SET = [
    "DateOfBirthDetector", "DriversLicenceDetector", "PostalCodeDetector",
    "en_GB.NationalInsuranceNumberDetector", "en_GB.TaxReferenceNumberDetector",
    "VehicleLicencePlateDetector", "TwitterDetector", "SkypeDetector", "CredentialDetector"]


def _detectors(names):
    return [DETECTORS[n] for n in names]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "lang", "text")


def _document_spans(spark: SparkSession, folder: str, keys=("doc_id",)) -> DataFrame:
    return pii.span_table(_documents(spark, folder), list(keys), "text", _detectors(DOCUMENT_SET))


def _canonical_spans(spark: SparkSession, folder: str, keys=("doc_id", "source")) -> DataFrame:
    return pii.allowed_types(_document_spans(spark, folder, keys))


def _positions(spans: DataFrame, *keys: str) -> DataFrame:
    return spans.select(
        *keys, F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"), "type", "text")


DOC_SPANS = O.spans("documents", ["doc_id", "source"], "text", DOCUMENT_SET)
CONTACT_SPANS = O.spans(f"({O.CONTACTS})", ["c_custkey", "c_mktsegment", "raw"], "raw", CONTACT_SET)


# --- Spans per detector -------------------------------------------------------------------------

def _register_span_query(key: str, detector: str, name: str, id_: str, column: str) -> None:
    sql = (f"SELECT {id_}, start_pos, end_pos, type, text FROM "
           f"({O.spans(name, [id_], column, [detector])})")

    @query(key, sql)
    def run(spark, folder):
        return _positions(
            pii.span_table(table(spark, folder, name), [id_], column, _detectors([detector])), id_)


for _key, _detector, _table, _id, _column in [
    ("pii_spans_ip", IP, "documents", "doc_id", "text"),
    ("pii_spans_email", EMAIL, "documents", "doc_id", "text"),
    ("pii_spans_cc", CARD, "documents", "doc_id", "text"),
    ("pii_spans_phone", PHONE, "pages", "page_id", "html"),
    ("pii_spans_ssn", SSN, "pages", "page_id", "html"),
    ("pii_spans_url", URL, "pages", "page_id", "url"),
    ("pii_spans_credential", CREDENTIAL, "documents", "doc_id", "text"),
]:
    _register_span_query(_key, _detector, _table, _id, _column)


@query("pii_spans_contacts", f"""
SELECT c_custkey, start_pos, end_pos, type, text FROM ({CONTACT_SPANS})""")
def pii_spans_contacts(spark, folder):
    return _positions(pii.span_table(
        customer_contacts(spark, folder), ["c_custkey"], "raw", _detectors(CONTACT_SET)), "c_custkey")


_K = "CAST(c_custkey AS VARCHAR)"
_NOTE_VALUES = {
    "DateOfBirthDetector": f"'19'||{O.digits('c_custkey', 2)}||'-'||{O.digits('(c_custkey%9+1)', 2)}"
                           f"||'-'||{O.digits('(c_custkey%28+1)', 2)}",
    "DriversLicenceDetector": f"'ABCDE'||{O.digits('c_custkey', 6)}||'AB'||(c_custkey%10)||'XY'",
    "PostalCodeDetector": "'SW'||(c_custkey%9+1)||'A '||(c_custkey%10)||'AA'",
    "en_GB.NationalInsuranceNumberDetector": f"'AB'||{O.digits('c_custkey', 6)}||'C'",
    "en_GB.TaxReferenceNumberDetector": f"'12345 '||{O.digits('c_custkey', 5)}",
    "VehicleLicencePlateDetector": f"'AB'||{O.digits('c_custkey', 2)}||' CDE'",
    "TwitterDetector": f"'@cust'||{_K}",
    "SkypeDetector": f"'live.user'||{_K}",
    "CredentialDetector": f"'pw'||{O.digits('c_custkey', 6)}||'x'",
}


@query("pii_spans_more", " UNION ALL ".join(
    f"SELECT c_custkey, '{t}' AS type, {v} AS text FROM customer" for t, v in _NOTE_VALUES.items()))
def pii_spans_more(spark, folder):
    return pii.span_table(
        customer_notes(spark, folder), ["c_custkey"], "note", _detectors(NOTE_SET),
    ).select("c_custkey", "type", "text")


@query("pii_counts", " UNION ALL ".join(
    f"SELECT '{d}' AS type, CAST(coalesce(sum(len(list_filter(regexp_extract_all(text, "
    f"{O.lit(DETECTORS[d].pattern)}, {2 if DETECTORS[d].in_context else 0}), "
    f"lambda m: length(trim(m)) >= 3))), 0) AS BIGINT) AS items FROM documents"
    for d in DOCUMENT_SET))
def pii_counts(spark, folder):
    return pii.type_counts(_documents(spark, folder), "text", _detectors(DOCUMENT_SET))


# --- Custom patterns and selection --------------------------------------------------------------

_CUSTOM_SQL = O.custom_spans("documents", ["doc_id"], "text", [
    ("EMPLOYEE MAIL", r"(?i)\b([a-z]+)\.\d{2}@mail\d\.example\.com"), ("HEX TOKEN", r"(?i)[0-9a-f]{32,}")])


@query("pii_custom_patterns", f"""
SELECT doc_id, start_pos, end_pos, type, text, 0.9::DOUBLE AS score FROM ({_CUSTOM_SQL})""")
def pii_custom_patterns(spark, folder):
    found = pii.span_table(
        _documents(spark, folder), ["doc_id"], "text", custom_detectors(CUSTOM, spark))
    return found.select(
        "doc_id", F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"), "type", "text", "score")


@query("pii_all", f"""
SELECT doc_id, start_pos, end_pos, type, text FROM ({DOC_SPANS})
UNION ALL SELECT doc_id, start_pos, end_pos, type, text FROM ({_CUSTOM_SQL})""")
def pii_all(spark, folder):
    both = _detectors(DOCUMENT_SET) + custom_detectors(CUSTOM, spark)
    return _positions(pii.span_table(_documents(spark, folder), ["doc_id"], "text", both), "doc_id")


_SHIPPED = [n for n in P.SHIPPED_DETECTORS.split("|")]


@query("pii_detectors_selected", " UNION ALL ".join(
    f"SELECT '{n}' AS type, CAST(coalesce(sum(len(list_filter(regexp_extract_all(text, "
    f"{O.lit(DETECTORS[n].pattern)}, {2 if DETECTORS[n].in_context else 0}), "
    f"lambda m: length(trim(m)) >= 3))), 0) AS BIGINT) AS items FROM conversations" for n in _SHIPPED))
def pii_detectors_selected(spark, folder):
    chosen = select_detectors(P.SHIPPED_DETECTORS + "|NoSuchDetector", P.DEFAULT_DETECTORS)
    return pii.type_counts(table(spark, folder, "conversations"), "text", chosen)


@query("pii_allowlist", f"""
SELECT doc_id, canonical, text FROM ({O.canonical(DOC_SPANS)})
WHERE canonical IN ({O.strings(P.PII_TYPE_ALLOWLIST)})
  AND canonical NOT IN ({O.strings(P.PII_TYPE_IGNORELIST)})""")
def pii_allowlist(spark, folder):
    return _canonical_spans(spark, folder).select("doc_id", "canonical", "text")


@query("pii_selected", f"""
SELECT doc_id, canonical, text FROM ({O.canonical(DOC_SPANS)})
WHERE canonical IN ('EMAIL', 'CREDIT_CARD')""")
def pii_selected(spark, folder):
    return pii.selected_types(
        _canonical_spans(spark, folder), ["EMAIL", "CREDIT_CARD"]).select("doc_id", "canonical", "text")


@query("pii_types_custom", f"""
SELECT DISTINCT trim(source) AS type FROM documents
WHERE trim(source) <> '' AND upper(trim(source)) NOT IN
  ({O.strings(P.PII_TYPE_ALLOWLIST + P.PII_TYPE_IGNORELIST)})
UNION ALL SELECT DISTINCT canonical FROM ({O.canonical(DOC_SPANS)})""")
def pii_types_custom(spark, folder):
    wanted = _documents(spark, folder).select(F.col("source").alias("type"))
    built_in = _canonical_spans(spark, folder).select(F.col("canonical").alias("type")).distinct()
    return pii.new_custom_types(wanted).unionByName(built_in)


# --- Reports ------------------------------------------------------------------------------------

_PATTERN_OF = " ".join(
    f"WHEN '{t}' THEN {O.lit(P.REDACTION_PATTERNS[t])}" for t in P.REDACTION_PATTERNS)


@query("pii_summary", f"""
SELECT canonical, count(DISTINCT text) AS value_count, count(*) AS items,
  arg_min(CASE type {_PATTERN_OF} ELSE {O.escaped('text')} END, (doc_id, start_pos)) AS regex_pattern
FROM ({O.canonical(DOC_SPANS)}) GROUP BY canonical""")
def pii_summary(spark, folder):
    return pii.summary(_canonical_spans(spark, folder), "doc_id")


@query("pii_values", f"""
SELECT canonical, text, count(*) AS items FROM ({O.canonical(DOC_SPANS)}) GROUP BY canonical, text""")
def pii_values(spark, folder):
    return pii.value_counts(_canonical_spans(spark, folder))


@query("pii_totals", f"""
SELECT count(*) AS types, CAST(coalesce(sum(v), 0) AS BIGINT) AS values FROM (
  SELECT canonical, count(DISTINCT text) AS v FROM ({O.canonical(DOC_SPANS)}) GROUP BY canonical)""")
def pii_totals(spark, folder):
    return pii.totals(pii.summary(_canonical_spans(spark, folder), "doc_id"))


@query("pii_suggestion", f"""
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS total_detected,
  CASE WHEN s.n IS NULL THEN 'No PII detected.' ELSE 'Detected PII types: ' || s.types ||
    '. Recommended action: Review and mask sensitive data before indexing.' END AS suggestion
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT type, ', ' ORDER BY type) AS types
  FROM ({DOC_SPANS}) GROUP BY doc_id) s USING (doc_id)""")
def pii_suggestion(spark, folder):
    found = pii.with_spans(
        _documents(spark, folder).select("doc_id", "text"), "text", _detectors(DOCUMENT_SET))
    return found.select(
        "doc_id", F.size("spans").cast("bigint").alias("total_detected"),
        pii.suggestion(F.col("spans")).alias("suggestion"))


@query("pii_topk", f"""
SELECT canonical, text, items, rank FROM (
  SELECT canonical, text, count(*) AS items,
    row_number() OVER (PARTITION BY canonical ORDER BY count(*) DESC, text) AS rank
  FROM ({O.canonical(DOC_SPANS)}) GROUP BY canonical, text) WHERE rank <= 3""")
def pii_topk(spark, folder):
    return pii.top_values(_canonical_spans(spark, folder), 3).withColumn(
        "rank", F.col("rank").cast("bigint"))


_CONTACT_FIELDS = O.infer_field(O.canonical(CONTACT_SPANS), "raw")


def _contact_details(spark, folder):
    found = pii.span_details(
        customer_contacts(spark, folder), ["c_custkey", "c_mktsegment"], "raw",
        _detectors(CONTACT_SET))
    return found.withColumn("canonical", canonical_type(F.col("type")))


@query("pii_infer_field", f"""
SELECT c_custkey, start_pos, type, field FROM ({_CONTACT_FIELDS})""")
def pii_infer_field(spark, folder):
    return _contact_details(spark, folder).select(
        "c_custkey", F.col("start").cast("bigint").alias("start_pos"), "type", "field")


@query("pii_infer_field_docs", f"""
SELECT doc_id, start_pos, type, field FROM ({O.infer_field(O.spans(
    "documents", ["doc_id", "text AS raw"], "text", DOCUMENT_SET), "raw")})""")
def pii_infer_field_docs(spark, folder):
    return pii.span_details(
        _documents(spark, folder), ["doc_id"], "text", _detectors(DOCUMENT_SET),
    ).select("doc_id", F.col("start").cast("bigint").alias("start_pos"), "type", "field")


@query("pii_infer_field_nearest", f"""
SELECT c_custkey, start_pos, type, CASE
  WHEN c_custkey % 3 = 0 THEN CASE type WHEN '{EMAIL}' THEN 'mail' WHEN '{IP}' THEN 'addr'
    WHEN '{PHONE}' THEN 'tel' END
  WHEN c_custkey % 3 = 2 AND type = '{EMAIL}' THEN 'm' ELSE field END AS field
FROM ({_CONTACT_FIELDS})""")
def pii_infer_field_nearest(spark, folder):
    return pii.span_details(
        customer_contacts(spark, folder), ["c_custkey"], "raw", _detectors(CONTACT_SET), nearest=True,
    ).select("c_custkey", F.col("start").cast("bigint").alias("start_pos"), "type", "field")


@query("pii_regex_for_type", f"""
SELECT doc_id, start_pos, type, CASE type {_PATTERN_OF} ELSE {O.escaped('text')} END AS regex_pattern
FROM ({DOC_SPANS})""")
def pii_regex_for_type(spark, folder):
    return _document_spans(spark, folder).select(
        "doc_id", F.col("start").cast("bigint").alias("start_pos"), "type",
        S.redaction_pattern(F.col("type"), F.col("text")).alias("regex_pattern"))


@query("pii_impact", f"""
SELECT canonical, count(*) AS instances, count(DISTINCT field) AS fields,
  count(DISTINCT c_custkey) AS events
FROM ({_CONTACT_FIELDS}) GROUP BY canonical""")
def pii_impact(spark, folder):
    return pii.impact(_contact_details(spark, folder), "c_custkey")


@query("pii_impact_rollup", f"""
SELECT c_mktsegment, canonical, count(*) AS instances, count(DISTINCT field) AS fields,
  count(DISTINCT c_custkey) AS events, CAST(grouping_id(c_mktsegment, canonical) AS BIGINT) AS level
FROM ({_CONTACT_FIELDS}) GROUP BY ROLLUP (c_mktsegment, canonical)""")
def pii_impact_rollup(spark, folder):
    return pii.impact(
        _contact_details(spark, folder), "c_custkey", ["c_mktsegment", "canonical"], rollup=True)


@query("pii_matrix", f"""
SELECT source, count(*) FILTER (canonical = 'EMAIL') AS email,
  count(*) FILTER (canonical = 'IP_ADDRESS') AS ip_address,
  count(*) FILTER (canonical = 'CREDIT_CARD') AS credit_card,
  count(*) FILTER (canonical = 'PASSWORD') AS password
FROM ({O.canonical(DOC_SPANS)}) GROUP BY source""")
def pii_matrix(spark, folder):
    return pii.type_matrix(
        _canonical_spans(spark, folder), "source", ["EMAIL", "IP_ADDRESS", "CREDIT_CARD", "PASSWORD"])


@query("pii_matrix_cube", f"""
SELECT source, canonical, count(*) AS items FROM ({O.canonical(DOC_SPANS)})
GROUP BY CUBE (source, canonical)""")
def pii_matrix_cube(spark, folder):
    return _canonical_spans(spark, folder).cube("source", "canonical").agg(
        F.count("*").alias("items"))


@query("pii_common_types", f"""
WITH p AS (SELECT DISTINCT lang, canonical FROM ({O.canonical(O.spans(
    "documents", ["doc_id", "lang"], "text", DOCUMENT_SET))}))
SELECT canonical, count(*) AS groups FROM p GROUP BY canonical
HAVING count(*) = (SELECT count(DISTINCT lang) FROM p)""")
def pii_common_types(spark, folder):
    return pii.common_types(_canonical_spans(spark, folder, ("doc_id", "lang")), "lang")


# --- One span per place, islands, overlaps ------------------------------------------------------

# Phone and e-mail overlap with these broad patterns, so places and islands have work to do.
BROAD = [("digits", r"\d{4}[\d-]*\d"), ("mail host", r"[a-z0-9]+@[a-z.]+")]
_BROAD_SQL = O.custom_spans(
    f"({O.CONTACTS})", ["c_custkey"], "raw", [(n.upper(), f"(?i){p}") for n, p in BROAD], first=6)
_MIXED = f"""SELECT c_custkey, start_pos, end_pos, ord, type, text, 1.0::DOUBLE AS score FROM ({CONTACT_SPANS})
UNION ALL SELECT c_custkey, start_pos, end_pos, ord, type, text, 0.9::DOUBLE FROM ({_BROAD_SQL})"""


def _mixed_detectors(spark):
    return _detectors(CONTACT_SET) + custom_detectors(BROAD, spark)


@query("pii_best_span", f"""
SELECT c_custkey, start_pos, end_pos, type, text FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey, start_pos, end_pos ORDER BY score DESC, ord) AS rn
  FROM ({_MIXED})) WHERE rn = 1""")
def pii_best_span(spark, folder):
    found = pii.with_spans(
        customer_contacts(spark, folder).select("c_custkey", "raw"), "raw", _mixed_detectors(spark))
    best = found.select("c_custkey", S.best_per_position(F.col("spans")).alias("spans"))
    return _positions(each(best, ["c_custkey"], "spans").select("c_custkey", "s.*"), "c_custkey")


@query("pii_best_span_table", f"""
SELECT c_custkey, start_pos, end_pos, type, text FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey, start_pos, end_pos ORDER BY score DESC, ord) AS rn
  FROM ({_MIXED})) WHERE rn = 1""")
def pii_best_span_table(spark, folder):
    spans = pii.span_table(
        customer_contacts(spark, folder), ["c_custkey"], "raw", _mixed_detectors(spark))
    return _positions(pii.best_span_rows(spans, "c_custkey"), "c_custkey")


@query("pii_merge_spans", f"""
WITH f AS (
  SELECT *, CASE WHEN start_pos < max(end_pos) OVER (PARTITION BY c_custkey
      ORDER BY start_pos, end_pos, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS opens FROM ({_MIXED})),
g AS (
  SELECT *, sum(opens) OVER (PARTITION BY c_custkey ORDER BY start_pos, end_pos, ord
    ROWS UNBOUNDED PRECEDING) AS isle FROM f)
SELECT c_custkey, min(start_pos) AS start_pos, max(end_pos) AS end_pos,
  arg_min(type, (start_pos, end_pos, ord)) AS type, count(*) AS spans
FROM g GROUP BY c_custkey, isle""")
def pii_merge_spans(spark, folder):
    found = pii.with_spans(
        customer_contacts(spark, folder).select("c_custkey", "raw"), "raw", _mixed_detectors(spark))
    isles = each(found, ["c_custkey"], S.merge_overlaps(F.col("spans"))).select("c_custkey", "s.*")
    return isles.select(
        "c_custkey", F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"), "type", F.col("spans").cast("bigint").alias("spans"))


@query("pii_overlaps", f"""
WITH m AS ({_MIXED})
SELECT a.c_custkey, a.type AS type_a, a.start_pos AS start_a, a.end_pos AS end_a,
  b.type AS type_b, b.start_pos AS start_b, b.end_pos AS end_b
FROM m a JOIN m b ON a.c_custkey = b.c_custkey
  AND (a.start_pos, a.end_pos, a.ord) < (b.start_pos, b.end_pos, b.ord)
  AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos""")
def pii_overlaps(spark, folder):
    spans = pii.span_table(
        customer_contacts(spark, folder), ["c_custkey"], "raw", _mixed_detectors(spark))
    pairs = pii.overlaps(spans, "c_custkey")
    return pairs.withColumns({
        c: F.col(c).cast("bigint") for c in ("start_a", "end_a", "start_b", "end_b")})


# --- Known values and evaluation ----------------------------------------------------------------

@query("pii_dictionary", """
WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_@.-]+'),
    lambda w: w <> '')) AS token FROM documents),
d AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]+')) AS token FROM benchmark)
SELECT token, count(*) AS items, count(DISTINCT doc_id) AS docs
FROM t WHERE token IN (SELECT token FROM d) GROUP BY token""")
def pii_dictionary(spark, folder):
    known = table(spark, folder, "benchmark").select(
        F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("token"))
    return _per_token(pii.dictionary_hits(_documents(spark, folder), ["doc_id"], "text", known))


def _per_token(hits):
    return hits.groupBy("token").agg(F.sum("n").alias("items"), F.count("*").alias("docs"))


_PHRASE_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_@.-]+'), lambda w: w <> '')"


@query("pii_phrases", f"""
WITH b AS (SELECT {_PHRASE_WORDS} AS w FROM benchmark),
d AS (SELECT DISTINCT unnest(w) AS token FROM b UNION SELECT array_to_string(w[1:3], ' ') FROM b WHERE len(w) >= 3),
t AS (SELECT doc_id, {_PHRASE_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS token FROM t UNION ALL
  SELECT doc_id, array_to_string(w[i:i+2], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t))
SELECT token, count(*) AS items, count(DISTINCT doc_id) AS docs FROM g WHERE token IN (SELECT token FROM d) GROUP BY token""")
def pii_phrases(spark, folder):
    """A list of all words of the benchmark and of the phrases its items begin with."""
    words = pii._words("text")
    items = table(spark, folder, "benchmark")
    phrases = F.when(F.size(words) >= 3, F.array(F.array_join(F.slice(words, 1, 3), " "))).otherwise(
        F.array().cast("array<string>"))
    known = items.select(F.explode(F.concat(words, phrases)).alias("token"))
    return _per_token(pii.dictionary_hits(_documents(spark, folder), ["doc_id"], "text", known))


_EMPTY_PATTERNS = [r"\d{4}|(?=z)", r"(?<=\s)|@\w+", r"\b|\d+\.\d+"]


@query("pii_spans_empty_matches", "SELECT doc_id, true AS placed, true AS replaced FROM documents")
def pii_spans_empty_matches(spark, folder):
    """Patterns that also match empty text: every span is where it says, and nothing of it is left."""
    chosen = [S.Detector(f"P{i}", p) for i, p in enumerate(_EMPTY_PATTERNS)]
    found = redaction.redact_spans(
        pii.with_spans(_documents(spark, folder).select("doc_id", "text"), "text", chosen), "text", chosen)
    # Cut from blocks: a substring starts at the front of its text, for each span anew.
    placed = bind(text_blocks(F.col("text")), lambda blocks: F.forall(
        "spans", lambda s: cut_blocks(blocks, s["start"], s["end"]) == s["text"]))
    kept = F.length(F.regexp_replace("redacted", r"\[REDACTED_P\d\]", ""))
    islands = F.aggregate(S.merge_overlaps(F.col("spans")), F.lit(0), lambda n, i: n + i["end"] - i["start"])
    return found.select("doc_id", placed.alias("placed"), (kept == F.length("text") - islands).alias("replaced"))


_NARROW = r"\b[a-z]+\.\d{2}@mail\d\.example\.com\b"
_TRUTH = O.custom_spans("documents", ["doc_id"], "text", [(EMAIL, _NARROW)])


@query("pii_eval", f"""
WITH f AS (SELECT doc_id, start_pos, end_pos, type FROM ({O.spans(
    "documents", ["doc_id"], "text", [EMAIL, IP])})),
t AS (SELECT doc_id, start_pos, end_pos, type FROM ({_TRUTH})),
c AS (SELECT coalesce(f.type, t.type) AS type,
    count(*) FILTER (f.type IS NOT NULL AND t.type IS NOT NULL) AS true_positive,
    count(*) FILTER (t.type IS NULL) AS false_positive,
    count(*) FILTER (f.type IS NULL) AS false_negative
  FROM f FULL JOIN t ON f.doc_id = t.doc_id AND f.start_pos = t.start_pos
    AND f.end_pos = t.end_pos AND f.type = t.type GROUP BY 1)
SELECT *, true_positive::DOUBLE / nullif(true_positive + false_positive, 0) AS precision,
  true_positive::DOUBLE / nullif(true_positive + false_negative, 0) AS recall FROM c""")
def pii_eval(spark, folder):
    docs = _documents(spark, folder)
    found = pii.span_table(docs, ["doc_id"], "text", _detectors([EMAIL, IP]))
    tagged = pii.span_table(docs, ["doc_id"], "text", [S.Detector(EMAIL, _NARROW, "@")])
    return pii.evaluate(found, tagged, ["doc_id", "start", "end", "type"])


@query("pii_pattern_table", f"""
SELECT event_id, 'USER_' || user_id AS type, CAST(strpos(line, 'user=') - 1 AS INTEGER) AS start,
  CAST(strpos(line, 'user=') + 4 + length(login) AS INTEGER) AS "end", 'user=' || login AS text
FROM (SELECT *, 'ts=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' user=' || login AS line FROM ({O.EVENTS}))""")
def pii_pattern_table(spark, folder):
    """A pattern per user, as many as the table has users, against all lines."""
    events = R.typed_events(spark, folder)
    patterns = events.select(
        F.concat(F.lit("user_"), "user_id").alias("name"), F.concat(F.lit("user="), "login", F.lit(r"\b")).alias("regex")).distinct()
    lines = events.select("event_id", R.kv_line().alias("raw"))
    return pattern_table.find_spans(lines, ["event_id"], "raw", patterns).select("event_id", "type", "start", "end", "text")
