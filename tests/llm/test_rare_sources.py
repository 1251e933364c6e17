"""A rare source meets its share."""

import pytest
from pyspark.sql import functions as F

from logsluice.llm import mixing


@pytest.mark.parametrize("share", [0.05, 0.3])
def test_rare_source_meets_its_target(spark, share):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 8, "rare").otherwise("hot").alias("source"), F.lit("ten chars.").alias("text"))
    rows = mixing.mix(docs, {"rare": share}, 1 - share)
    got = {r["source"]: r for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.first("mix_rate").alias("rate")).collect()}
    assert got["rare"]["rate"] == pytest.approx(share * 40_000 / 8)
    assert got["rare"]["n"] / (got["rare"]["n"] + got["hot"]["n"]) == pytest.approx(share, rel=0.1)
    copies = rows.filter("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("mix_copy").alias("d")).collect()
    assert len(copies) == 8 and all(r["n"] == r["d"] for r in copies)
