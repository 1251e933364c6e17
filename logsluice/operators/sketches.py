"""Field profiles as mergeable sketches: one small row per sourcetype, field and hour.

``field_profile`` counts exactly and shuffles each distinct value. Here every partition reduces its values to three
sketches per group before the shuffle, whose size then doesn't depend on the number of values. Sketches of hours, days or
tables are merged for any range without reading the lines again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Distinct values: relative standard error 1.04 / sqrt(2 ** HLL_BITS), below one percent; small numbers are exact.
HLL_BITS = 14
# Frequent values: counts are exact while a group has at most three quarters of so many values, else lower bounds.
TRACKED = 4096
# Quantiles: error of the rank with 99 % confidence, about one percent.
KLL_K = 200

KEYS = ("sourcetype", "name", "hour")


def sketch(records: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """From ``(sourcetype, name, value, ts)`` a row per sourcetype, name and hour.

    ``(sourcetype, name, hour, records, empty, distinct, frequent, numbers)``: the number of records, of NULL values among
    them, and the sketches of distinct values, of frequent ones and of the numbers among the values.
    """
    number = F.expr("try_cast(value AS DOUBLE)")
    return records.withColumn("hour", F.date_trunc("hour", "ts")).groupBy(*KEYS).agg(
        F.count("*").alias("records"), F.count_if(F.col("value").isNull()).alias("empty"),
        F.hll_sketch_agg("value", HLL_BITS).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("frequent"),
        F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias("numbers"))


def merge(sketches: DataFrame, keys: Sequence[str] = ("sourcetype", "name"), tracked: int = TRACKED) -> DataFrame:
    """Sketches of coarser groups; the result can be merged again."""
    return sketches.groupBy(*keys).agg(
        F.sum("records").alias("records"), F.sum("empty").alias("empty"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {tracked})").alias("frequent"),
        F.expr("kll_merge_agg_double(numbers)").alias("numbers"))


def estimates(
    sketches: DataFrame, top: int = 10, quantiles: Sequence[float] = (0.0, 0.5, 0.95, 1.0),
) -> DataFrame:
    """The sketches' answers: ``distinct_values``, ``top`` as ``array<struct<item,count>>``, ``quantiles``.

    Groups without a number have NULL quantiles, those without a value no frequent ones.
    """
    keys = [c for c in sketches.columns if c not in ("records", "empty", "distinct", "frequent", "numbers")]
    asked = F.array(*[F.lit(float(q)) for q in quantiles])
    numbers = F.when(F.kll_sketch_get_n_double("numbers") > 0, F.kll_sketch_get_quantile_double("numbers", asked))
    return sketches.select(
        *keys, "records", "empty", F.hll_sketch_estimate("distinct").alias("distinct_values"),
        F.expr(f"filter(approx_top_k_estimate(frequent, {top}), x -> x.item IS NOT NULL)").alias("top"), numbers.alias("quantiles"))
