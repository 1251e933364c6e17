"""Sketches of fields: merged in any order they answer alike, within their stated errors."""

import pytest
from pyspark.sql import functions as F

from logsluice.operators import sketches as S
from tests.test_plans import plan


def records(spark, n=60_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("sourcetype"),
        F.lit("f").alias("name"), F.when(F.col("id") % 10 == 0, "often").when(F.col("id") % 11 == 0, None).otherwise(
            F.col("id").cast("string")).alias("value"),
        F.timestamp_seconds(F.col("id") * 3).alias("ts"))


def test_errors_and_merging(spark):
    rows = records(spark)
    hours = S.sketch(rows)
    once = {r["sourcetype"]: r for r in S.estimates(S.merge(hours)).collect()}
    twice = S.merge(S.merge(hours.withColumn("half", F.hour("hour") % 2), ["sourcetype", "name", "half"]))
    again = {r["sourcetype"]: r for r in S.estimates(twice).collect()}
    exact = {r["sourcetype"]: r for r in rows.groupBy("sourcetype").agg(
        F.count_distinct("value").alias("d"), F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("e"),
        F.count_if(F.col("value") == "often").alias("often"), F.expr("percentile(try_cast(value AS DOUBLE), 0.5)").alias("mid")).collect()}
    assert once.keys() == again.keys() == exact.keys()
    for key, r in exact.items():
        for got in (once[key], again[key]):
            assert got["records"] == r["n"] and got["empty"] == r["e"]
            assert got["distinct_values"] == pytest.approx(r["d"], rel=0.04)
            assert got["quantiles"][1] == pytest.approx(r["mid"], rel=0.06)
            if r["often"]:
                assert got["top"][0]["item"] == "often" and 0.9 * r["often"] <= got["top"][0]["count"] <= 1.1 * r["often"]


def test_one_row_per_group_is_shuffled(spark):
    text = plan(S.sketch(records(spark)))
    before, after = text.index("partial_hll_sketch_agg"), text.index("hashpartitioning")
    assert "value" not in text[after:text.index("\n", after)] and before != after


def test_odd_values(spark):
    rows = spark.createDataFrame([("a", "x", None, None), (None, "x", "y", None), ("a", "x", "", None)], "sourcetype string, name string, value string, ts timestamp")
    got = {r["sourcetype"]: r for r in S.estimates(S.merge(S.sketch(rows))).collect()}
    assert got["a"]["empty"] == 1 and got["a"]["distinct_values"] in (0, 1) and got["a"]["quantiles"] is None
    assert [t["item"] for t in got[None]["top"]] == ["y"]
    assert S.estimates(S.merge(S.sketch(rows.limit(0)))).collect() == []
