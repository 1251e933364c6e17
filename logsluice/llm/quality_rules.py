"""Quality rules with risk-controlled thresholds.

Each rule compares one number of a document with a cutoff. Cutoffs are chosen per stratum (language) from
labelled documents: a cutoff may be used if, with confidence ``1 - delta``, it rejects at most ``alpha`` of the good
documents of the stratum. That is told by the exact (Clopper-Pearson) upper bound on the share of good
documents that it rejects. ``delta`` is divided by the number of rules and strata (Bonferroni); within
a rule the grid of cutoffs is tested from the mildest on and testing stops at the first that fails, so
the grid costs no further correction. Cutoffs that reject nothing beyond good documents gain nothing, but keep the
guarantee.

Numbers of all whole documents are computed once and written; labels join narrow rows only. What comes
together per stratum is a histogram over rules and cutoffs, not documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsluice.llm.common import binary_column, cut, small

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ALPHA, DELTA = 0.01, 0.05
# Cutoffs of each rule from the mildest on; a document above one is rejected.
GRIDS = {
    "symbol_ratio": (2.0, 1.0, 0.5, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_ratio": (0.9, 0.7, 0.5, 0.3, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1),
    "long_words": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
}
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# --- numbers of one document ---------------------------------------------------------------------------

def repeat_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(windows) == len(set(windows)):
        return 0
    times, count, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            count += i + size - max(i, covered)
            covered = i + size
    return count


def numbers(text: bytes) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of a UTF-8 text. ``bytes.split`` parts at space and the codes 9 to 13."""
    words = text.split()
    code_points = sum(map(len, words)) - len(text) + len(text.translate(None, _CONTINUED))
    lines = [line for line in text.split(b"\n") if line.split()]
    return (len(words), code_points, len(text.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)),
            repeat_words(words))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary_column(batch, "text")
        rows = [(*numbers(t), sum(1 for line in t.split(b"\n") if line.split())) for t in texts]
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("stratum"), *[pa.array(c, pa.int64()) for c in columns]],
            ["id", "stratum", *COUNTS, "n_lines"])


def document_numbers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """``(id, stratum, *COUNTS, n_lines)`` and the ratios that the rules test, per row."""
    narrow = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
        F.col(text_col).cast("string").alias("text"))
    counted = narrow.mapInArrow(
        _numbers, "id long, stratum string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_lines")))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return counted.withColumns({
        "symbol_ratio": share("n_symbols", "n_words"), "repeat_ratio": share("n_repeat_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"), "long_words": share("word_chars", "n_words")})


# --- thresholds ----------------------------------------------------------------------------------------

def upper_bound(rejected: int, total: int, delta: float) -> float:
    """Exact upper confidence bound on a share of which ``rejected`` of ``total`` were seen."""
    if rejected >= total:
        return 1.0

    def at_most(p: float) -> float:
        """P(X <= rejected) for a binomial X, the terms from the largest down."""
        log_odds, term = math.log(p) - math.log1p(-p), None
        top = min(rejected, int((total + 1) * p))
        log_top = (math.lgamma(total + 1) - math.lgamma(top + 1) - math.lgamma(total - top + 1)
                   + top * math.log(p) + (total - top) * math.log1p(-p))
        total_share, term = 1.0, 1.0
        for k in range(top, 0, -1):
            term *= k / (total - k + 1) / math.exp(log_odds)
            total_share += term
            if term < 1e-17:
                break
        term = 1.0
        for k in range(top + 1, rejected + 1):
            term *= (total - k + 1) / k * math.exp(log_odds)
            total_share += term
            if term < 1e-17:
                break
        return math.exp(log_top) * total_share

    low, high = rejected / total, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if at_most(min(max(middle, 1e-12), 1 - 1e-12)) > delta:
            low = middle
        else:
            high = middle
    return high


def _choose(rows: pd.DataFrame, tests: int, alpha: float, delta: float) -> pd.DataFrame:
    """The last cutoff of a rule that passes, before the first that fails."""
    rows = rows.sort_values("position")
    best = None
    for r in rows.itertuples():
        bound = upper_bound(int(r.rejected), int(r.good), delta / tests)
        if bound > alpha:
            break
        best = (r.cutoff, bound)
    first = rows.iloc[0]
    return pd.DataFrame({
        "stratum": [first["stratum"]], "rule": [first["rule"]], "cutoff": [best and best[0]],
        "bound": [best and best[1]], "good": [int(first["good"])]})


def choose_cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grids: dict = GRIDS) -> DataFrame:
    """``(stratum, rule, cutoff, bound, good)`` from the numbers of labelled good documents.

    ``cutoff`` is NULL where no cutoff can be guaranteed, as with few labels.
    """
    strata = max(1, good.select("stratum").distinct().count())
    sums = [F.count_if(F.col(rule) > c).alias(f"{rule}_{i}") for rule, grid in grids.items() for i, c in enumerate(grid)]
    counted = good.groupBy("stratum").agg(F.count("*").alias("good"), *sums)
    tests = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("position"), F.lit(float(c)).alias("cutoff"),
                 F.col(f"{rule}_{i}").alias("rejected"))
        for rule, grid in grids.items() for i, c in enumerate(grid)])
    rows = counted.select("stratum", "good", F.inline(tests))
    return rows.groupBy("stratum", "rule").applyInPandas(
        lambda rows: _choose(rows, strata * len(grids), alpha, delta),
        "stratum string, rule string, cutoff double, bound double, good long")


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    good: str = "quality = 1", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """One row per document: ``(id, stratum, *COUNTS, n_lines, ratios, base_failed, broken, kept)``.

    ``broken`` lists the rules that reject it. Base rules are fixed: fewer than ``MIN_WORDS`` words, or more
    than ``MAX_REPEAT_PERCENT`` percent repeated words. NULL or empty text has no words and fails the base. NULL
    is a stratum of its own. A label that is repeated counts once; NULL labels and labels of absent
    documents don't count; repeated documents are judged each. An empty table gives no rows.
    """
    measured = cut(document_numbers(docs, id_col, text_col, stratum_col))
    trusted = small(cut(labels.filter(good).select(F.col(id_col).cast("long").alias("_good")).distinct()))
    cutoffs = choose_cutoffs(measured.join(trusted, F.col("id") == F.col("_good"), "left_semi"), alpha, delta)
    table = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(
        F.struct("rule", "cutoff"))).alias("_cutoffs")).withColumnRenamed("stratum", "_stratum")
    table = small(cut(table), 100_000)
    joined = measured.join(table, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    broken = F.array_compact(F.array(*[
        F.when(F.col(rule) > F.col("_cutoffs")[rule], F.lit(rule)) for rule in GRIDS]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.withColumns({"broken": broken, "base_failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("_stratum", "_cutoffs")
