"""Secret scans over an inverted index of trigrams.

Each rule's regular expression gives a Boolean query of trigrams that any match must hold. The index has a
posting for every trigram of those queries (a stated query set) and every document that contains it,
ignoring case. Postings are joined with the clauses of the rules and intersected by counting; the documents
that satisfy a clause are the candidates of its rule, and only they are searched with its expression. Rules
without mandatory trigrams search every document.

DataFrame expressions only. A posting is narrow (document key and trigram), the intersection groups by
document, so no group grows with the corpus. Candidates return to the texts by a broadcast join if they
are few, counted, else by a shuffled one. Texts that are equal share a key, and so an answer.

Spans of one expression are found with one split and one extraction over the whole text; their places come
from running sums in logarithmically many steps, so a text with very many matches takes no quadratic time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logsluice.functions.rows import bind
from logsluice.llm.common import cut, small
from logsluice.llm.licenses import lowered
from logsluice.llm.trigram_query import trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` for both Java and Python; a match counts if it, or its group, has ``at_least`` characters."""

    kind: str
    pattern: str
    at_least: int = 0
    group: int = 0
    base: bool = False


# The base rules, then the forms of well-known keys that the method adds.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)", 8, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", "[0-9a-f]{32,}", 32, 0, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
)
SPANS = "array<struct<start:int,end:int,kind:string,base:boolean>>"


def running_sums(values: Column) -> Column:
    """Prefix sums of an array of ints, each with its own value, in log2(n) passes over the array."""
    def passes(array: Column) -> Column:
        steps = F.when(F.size(array) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(array))).cast("int") - 1)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(steps, array, lambda acc, k: F.transform(acc, lambda x, i: (
            x + F.when(i >= F.pow(2, k).cast("int"), F.get(acc, i - F.pow(2, k).cast("int"))).otherwise(0))))

    return bind(values, passes)


def matches(text: Column, rule: Rule) -> Column:
    """Spans of one rule in one text, leftmost and non-overlapping; offsets are code points.

    The pattern never matches empty text, so the pieces between the matches are those of a split.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def spans(pair: Column) -> Column:
        hits, ends = pair["hits"], pair["ends"]
        long_enough = (lambda m: F.length(m)) if not rule.group else (
            lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)))
        every = F.transform(hits, lambda m, i: F.when(long_enough(m) >= rule.at_least, F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"),
            F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base"))))
        return F.filter(every, lambda s: s.isNotNull())

    def placed(hits: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        widths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.length(g) + F.length(m))
        return bind(F.struct(hits.alias("hits"), running_sums(widths).alias("ends")), spans)

    none = F.array().cast(SPANS)
    return F.when(text.rlike(rule.pattern), bind(found, placed)).otherwise(none)


def _queries(rules: tuple[Rule, ...]) -> dict[int, list[list[str]]]:
    return {i: [sorted(c) for c in sorted(trigram_query(r.pattern), key=sorted)] for i, r in enumerate(rules)}


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, id, key)``: where each of the trigrams occurs, ignoring case; equal texts once per id."""
    low = lowered(F.col("text"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return texts.withColumn("low", low).select("id", "key", F.explode_outer(held).alias("trigram")).filter(
        F.col("trigram").isNotNull())


def candidates(texts: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame | None:
    """``(id, key, rules)``: documents that satisfy a clause of some rule, with those rules."""
    clauses = [(r, c, t, len(clause)) for r, each in queries.items() for c, clause in enumerate(each) for t in clause]
    if not clauses:
        return None
    wanted = texts.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("clause"), F.lit(t).alias("trigram"), F.lit(n).alias("need"))
        for r, c, t, n in clauses])))
    index = postings(texts, sorted({t for _, _, t, _ in clauses}))
    met = index.join(F.broadcast(wanted), "trigram").groupBy("id", "key", "rule", "clause", "need").agg(
        F.count_distinct("trigram").alias("held")).filter("held = need")
    return met.groupBy("id", "key").agg(F.collect_set("rule").alias("rules"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``(id, spans)`` per row; spans by start, then rule, with kind and whether the rule is a base one.

    A span of an added rule inside a base span is left out. NULL or empty text has no spans; repeated
    rows are answered each, a NULL id as well. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    queries = _queries(rules)
    named = candidates(texts, queries)
    if named is not None:
        named = small(cut(named.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "rules")))
        texts = texts.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    else:
        texts = texts.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast(SPANS)
    found = []
    for i, rule in enumerate(rules):
        spans = matches(F.col("text"), rule)
        found.append(spans if not queries[i] else F.when(F.array_contains("rules", i), spans).otherwise(none))
    order = {r.kind: i for i, r in enumerate(rules)}
    ranked = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])

    def tidy(every: Column) -> Column:
        sure = F.filter(every, lambda s: s["base"])
        kept = F.filter(every, lambda s: s["base"] | ~F.exists(
            sure, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        placed = F.array_sort(F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), ranked[s["kind"]].alias("rank"), s.alias("span"))))
        return F.transform(placed, lambda p: p["span"])

    return texts.select("id", F.flatten(F.array(*found)).alias("every")).select(
        "id", F.when(F.size("every") > 0, bind(F.col("every"), tidy)).otherwise(none).alias("spans"))


def digest(spans: str = "spans", base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    rows = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
