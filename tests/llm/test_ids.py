"""Rows without an id, and rows that repeat one, are decided on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.llm import decontaminate, mixing

ITEM = "the quick brown fox jumps over the lazy dog near a quiet river bank"


def test_contaminated_rows_go_whatever_their_id(spark):
    docs = spark.createDataFrame([
        (None, f"before {ITEM} after", "a"), (1, f"so {ITEM}", "b"), (1, "a clean text under the same id", "c"),
        (None, "clean, without an id", "d"), (2, None, "e"), (3, "", "f"), (4, f"so {ITEM}", "g")],
        "doc_id long, text string, _gone string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["_gone"] for r in left.collect()) == ["c", "d", "e", "f"]
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 7
    assert decontaminate.drop_contaminated(docs.limit(0), items).count() == 0


def test_rows_without_an_id_are_drawn_on_their_own(spark):
    docs = spark.range(4000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.lpad("id", 5, "0")).alias("text"),
        F.lit("s").alias("source"))
    mixed = mixing.mix(docs, {"s": 1.0}, rest=0.0, size=2.0)
    assert abs(mixed.count() / 8000 - 1) < 0.05
    assert mixed.select("mix_order").distinct().count() == mixed.count()


def test_rows_that_repeat_an_id_are_split(spark):
    docs = spark.range(20_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"),
        F.col("id").alias("place"))
    seed = next(s for s in map(str, range(50)) if mixing.mix(docs.limit(1), {"s": 1.0}, 0.0, seed=s).count() == 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.mix(docs, {"s": 1.0}, rest=0.0, seed=seed)
        sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert mixed.columns == ["doc_id", "text", "source", "place", "mix_rate", "mix_copy", "mix_order"]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
