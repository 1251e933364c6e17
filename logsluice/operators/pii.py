"""Personal data: span tables, selection, reports, evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logsluice.functions import patterns as P
from logsluice.functions import spans as S
from logsluice.functions.rows import bind, cut_blocks, each, text_blocks
from logsluice.functions.spans import Detector
from logsluice.operators.detectors import canonical_type

OVERLAP_BIN_CHARS = 64


def with_spans(
    df: DataFrame, text: str, detectors: Sequence[Detector], out: str = "spans",
) -> DataFrame:
    """Add the spans of every document as an array, by position."""
    return df.withColumn(out, S.detect_all(text, detectors))


def span_table(
    df: DataFrame, keys: Sequence[str], text: str, detectors: Sequence[Detector],
) -> DataFrame:
    """One row per span: keys, start, end, ord, type, text, score."""
    found = with_spans(df.select(*keys, text), text, detectors)
    return each(found, keys, "spans").select(*keys, "s.*")


def span_details(
    df: DataFrame, keys: Sequence[str], text: str, detectors: Sequence[Detector],
    nearest: bool = False,
) -> DataFrame:
    """Span rows with the inferred field and the redaction pattern, as a scan reports them."""
    # The surroundings are cut inside the row, so no span carries its whole document.
    found = with_spans(df.select(*keys, text), text, detectors)
    blocks = F.when(F.size("spans") > 0, text_blocks(F.col(text)))

    def near(parts: Column) -> Column:
        return F.transform("spans", lambda s: F.struct(
            s.alias("s"), cut_blocks(
                parts, F.greatest(s["start"] - P.CONTEXT_CHARS, F.lit(0)),
                F.least(s["end"] + P.CONTEXT_CHARS, F.length(text))).alias("context")))

    rows = each(found, [*keys, F.col(text).rlike(P.LEADING_IP).alias("_access")], bind(blocks, near), "p")
    begin, type_ = F.col("p.s.start"), F.col("p.s.type")
    infer = S.nearest_field if nearest else S.infer_field
    return rows.select(
        *keys, "p.s.*", infer(F.col("_access"), F.col("p.context"), begin, type_).alias("field"),
        S.redaction_pattern(type_, F.col("p.s.text")).alias("regex_pattern"))


def type_counts(df: DataFrame, text: str, detectors: Sequence[Detector]) -> DataFrame:
    """Spans per type without offsets: a narrow scan and one small aggregate."""
    counts = df.select(*[
        S.count_matches(F.col(text), d).alias(f"c{i}") for i, d in enumerate(detectors)])
    totals = counts.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(detectors))])
    pairs = F.array(*[
        F.struct(F.lit(d.name).alias("type"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("items"))
        for i, d in enumerate(detectors)])
    return totals.select(F.inline(pairs))


# --- Selection ----------------------------------------------------------------------------------

def allowed_types(
    spans: DataFrame, custom_types: Iterable[str] = (), type_column: str = "type",
) -> DataFrame:
    """Spans whose canonical type is on the allow list, or was added by the user."""
    canonical = canonical_type(F.col(type_column))
    allowed = [*P.PII_TYPE_ALLOWLIST, *(t.upper() for t in custom_types)]
    return spans.withColumn("canonical", canonical).filter(
        F.col("canonical").isin(allowed) & ~F.col("canonical").isin(P.PII_TYPE_IGNORELIST))


def selected_types(spans: DataFrame, selected: Sequence[str], fall_back: bool = True) -> DataFrame:
    """Spans of the selected canonical types; with ``fall_back`` an empty selection keeps all."""
    if not selected:
        return spans if fall_back else spans.limit(0)
    return spans.filter(F.col("canonical").isin(list(selected)))


def new_custom_types(wanted: DataFrame, type_column: str = "type") -> DataFrame:
    """User types that are on neither list."""
    known = P.PII_TYPE_ALLOWLIST + P.PII_TYPE_IGNORELIST
    trimmed = F.trim(F.col(type_column))
    return wanted.filter((trimmed != "") & ~F.upper(trimmed).isin(known)).select(
        trimmed.alias(type_column)).distinct()


# --- Reports ------------------------------------------------------------------------------------

def value_counts(spans: DataFrame, keys: Sequence[str] = ("canonical",)) -> DataFrame:
    """Distinct values with their number of spans. The long form of a value set: however many
    values a type has, no row grows."""
    return spans.groupBy(*keys, "text").agg(F.count("*").alias("items"))


def summary(spans: DataFrame, doc: str) -> DataFrame:
    """Per canonical type: distinct values, spans, and the pattern of the first span.

    Values are counted per value first, so a type that holds most of the data is reduced on every
    executor before its few remaining rows meet.
    """
    place = F.struct(F.col(doc), F.col("start"), F.col("ord"))
    per_value = spans.groupBy("canonical", "text").agg(
        F.count("*").alias("items"),
        F.min(F.struct(place.alias("place"), F.col("type").alias("type"))).alias("first"))
    return per_value.groupBy("canonical").agg(
        F.count("*").alias("value_count"),
        F.sum("items").alias("items"),
        F.min(F.struct("first.place", "first.type", "text")).alias("first"),
    ).select(
        "canonical", "value_count", "items",
        S.redaction_pattern(F.col("first.type"), F.col("first.text")).alias("regex_pattern"))


def totals(summary_: DataFrame) -> DataFrame:
    return summary_.agg(
        F.count("*").alias("types"), F.coalesce(F.sum("value_count"), F.lit(0)).alias("values"))


def suggestion(spans: Column) -> Column:
    """Advice for one document from its spans."""
    types = F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"]))), ", ")
    return F.when(F.size(spans) == 0, "No PII detected.").otherwise(F.concat(
        F.lit("Detected PII types: "), types,
        F.lit(". Recommended action: Review and mask sensitive data before indexing.")))


def top_values(spans: DataFrame, k: int, keys: Sequence[str] = ("canonical",)) -> DataFrame:
    """The k most frequent values per type, ties by value.

    The rank filter becomes a group limit on the map side: at most k rows per type and partition
    are shuffled.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("items").desc(), "text")
    return value_counts(spans, keys).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k)


def impact(spans: DataFrame, doc: str, by: Sequence[str] = ("canonical",), rollup: bool = False) -> DataFrame:
    """What redaction would touch: spans, fields, events, by the given columns.

    Spans are counted per (group, field, event) first, so what the distinct counts of the levels expand is
    these few rows and not the spans.
    """
    seen = spans.groupBy(*by, "field", doc).agg(F.count("*").alias("_n"))
    group = seen.rollup if rollup else seen.groupBy
    measures = [
        F.coalesce(F.sum("_n"), F.lit(0)).alias("instances"),
        F.count_distinct("field").alias("fields"),
        F.count_distinct(doc).alias("events")]
    if rollup:
        measures.append(F.grouping_id().alias("level"))
    return group(*by).agg(*measures)


def type_matrix(spans: DataFrame, rows: str, types: Sequence[str]) -> DataFrame:
    """Spans per row value and type as a table; the listed types are the columns."""
    return spans.groupBy(rows).agg(*[
        F.count_if(F.col("canonical") == t).alias(t.lower()) for t in types])


def common_types(spans: DataFrame, group: str) -> DataFrame:
    """Types that occur in every group that has any span.

    The grand total of the rollup is the number of groups; the types that have it are joined to that one row.
    """
    pairs = spans.select(group, "canonical").distinct()
    counts = pairs.rollup("canonical").agg(F.count_distinct(group).alias("groups"), F.grouping("canonical").alias("total"))
    total = counts.filter("total = 1").select(F.col("groups").alias("all_groups"))
    return counts.filter("total = 0").join(total, F.col("groups") == F.col("all_groups"), "left_semi").select(
        "canonical", "groups")


# --- Joins --------------------------------------------------------------------------------------

def overlaps(spans: DataFrame, doc: str) -> DataFrame:
    """Pairs of spans of one document that share characters.

    Spans are put into bins of fixed width and compared within a bin only; a pair counts in the bin
    where the later of the two starts. Spans of one detector do not overlap and have at least three
    characters, so a bin holds at most width / 3 + 2 spans per detector, however long the document.
    The spans are found once and shuffled once.
    """
    span = F.struct("start", "end", "ord", "type")
    bins = each(
        spans, [doc, span.alias("s")],
        F.sequence(
            F.floor(F.col("start") / OVERLAP_BIN_CHARS),
            F.floor((F.col("end") - 1) / OVERLAP_BIN_CHARS)), "bin")
    groups = bins.groupBy(doc, "bin").agg(F.collect_list("s").alias("spans")).filter(F.size("spans") > 1)

    def partners(a: Column) -> Column:
        def meets(b: Column) -> Column:
            later = F.floor(F.greatest(a["start"], b["start"]) / OVERLAP_BIN_CHARS)
            before = F.struct(a["start"], a["end"], a["ord"]) < F.struct(b["start"], b["end"], b["ord"])
            return before & (a["start"] < b["end"]) & (b["start"] < a["end"]) & (later == F.col("bin"))

        return F.transform(
            F.filter("spans", meets), lambda b: F.struct(a.alias("a"), b.alias("b")))

    pairs = each(groups, [doc], F.flatten(F.transform("spans", partners)), "p")
    return pairs.select(doc, *[
        F.col(f"p.{side}.{part}").alias(f"{part}_{side}")
        for side in ("a", "b") for part in ("type", "start", "end")])


def known_values(tokens: DataFrame, dictionary: DataFrame, token: str = "token") -> DataFrame:
    """Tokens that are on a user's list. The list is de-duplicated; its size decides how Spark
    joins, there is no forced broadcast."""
    return tokens.join(dictionary.select(token).distinct(), token, "left_semi")


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_@.-]+"), lambda w: w != "")


def _counted(values: Column) -> Column:
    """Distinct values of an array with their number, from runs of the sorted array."""
    def runs(every: Column) -> Column:
        def counts(starts: Column) -> Column:
            return F.transform(starts, lambda at, i: F.struct(
                F.get(every, at).alias("token"),
                (F.coalesce(F.get(starts, i + 1), F.size(every)) - at).cast("bigint").alias("n")))

        places = F.filter(
            F.sequence(F.lit(0), F.size(every) - 1), lambda i: (i == 0) | (F.get(every, i) != F.get(every, i - 1)))
        return F.when(F.size(every) > 0, bind(places, counts))

    return bind(F.sort_array(values), runs)


def tokens(df: DataFrame, keys: Sequence[str], text: str, sizes: Sequence[int] = (1,)) -> DataFrame:
    """Distinct runs of one to several words per document and how often each occurs: ``(keys, token, n)``.

    They are counted inside the document's row, so a common word is one row per document.
    """
    def grams(words: Column) -> Column:
        return F.concat(*[
            words if size == 1 else F.when(F.size(words) >= size, F.transform(
                F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
            ).otherwise(F.array().cast("array<string>"))
            for size in sizes])

    return each(df, keys, _counted(bind(_words(text), grams)), "t").select(*keys, "t.*")


def dictionary_hits(
    df: DataFrame, keys: Sequence[str], text: str, dictionary: DataFrame, token: str = "token",
) -> DataFrame:
    """Words and phrases of a user's list that occur in a text, with their number per document.

    Phrases are compared as runs of words: each length that the list has gives one set of runs, joined on
    equality. The lengths are few and come to the driver.
    """
    known = dictionary.select(F.array_join(_words(token), " ").alias("token")).filter(F.col("token") != "").distinct()
    sizes = sorted(r["n"] for r in known.select(F.size(F.split("token", " ")).alias("n")).distinct().collect())
    return known_values(tokens(df, keys, text, sizes or [1]), known)


def evaluate(found: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall per type of found spans against tagged ones."""
    hit = found.select(*keys, F.lit(True).alias("_found"))
    tag = truth.select(*keys, F.lit(True).alias("_tagged"))
    both = hit.join(tag, list(keys), "full_outer")
    is_found, is_tagged = F.col("_found").isNotNull(), F.col("_tagged").isNotNull()
    counts = both.groupBy("type").agg(
        F.count_if(is_found & is_tagged).alias("true_positive"),
        F.count_if(is_found & ~is_tagged).alias("false_positive"),
        F.count_if(~is_found & is_tagged).alias("false_negative"))
    tp = F.col("true_positive").cast("double")
    return counts.withColumns({
        "precision": F.try_divide(tp, F.col("true_positive") + F.col("false_positive")),
        "recall": F.try_divide(tp, F.col("true_positive") + F.col("false_negative"))})


def best_span_rows(spans: DataFrame, doc: str) -> DataFrame:
    """For a span table from several sources: one span per place, highest score, earlier order on a
    tie. Aggregates on the map side; a place holds at most a few spans."""
    return spans.groupBy(doc, "start", "end").agg(
        F.max_by(F.struct("type", "text", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("s"),
    ).select(doc, "start", "end", "s.*")
