"""Work of learning templates: lines dealt out over tasks, no sort of a wide row per word."""

from pyspark.sql import functions as F

from logsluice.operators import templates as T
from logsluice.plans.queries_templates import _lines


def test_lines_of_one_file_are_learned_by_many_tasks(spark, tmp_path):
    spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(1.5).alias("value"), F.lit('{"k": 3}').alias("props")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = _lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in tasks) == 400 and len(tasks) > 1


def test_fixed_texts_are_found_without_sorting_every_word(spark):
    rows = [("s", ["<word>", " ", "<word>"], ["a", f"v{i}"], "") for i in range(50)]
    rows += [(None, ["<word>"], ["b"], ""), ("s", [], [], ""), ("s", ["<word>", " ", "<word>"], ["c", "d"], "/0:c")]
    nodes = spark.createDataFrame(rows, "sourcetype string, shape array<string>, words array<string>, node string").withColumn("n", F.lit(2))
    found = T._templates(nodes)
    assert "max(word" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["sourcetype"], tuple(r["shape"]), tuple((x["place"], x["text"]) for x in r["literals"])): r["lines"] for r in found.collect()}
    pair = ("<word>", " ", "<word>")
    assert got == {("s", pair, ((0, "a"),)): 100, (None, ("<word>",), ((0, "b"),)): 2, ("s", (), ()): 2, ("s", pair, ((0, "c"), (1, "d"))): 2}
