"""Work of span detection: dealt out over tasks, searched without lookaheads where none is needed, linear totals."""

import random
import re

from pyspark.sql import functions as F

from logsluice.functions import spans as S
from logsluice.functions.rows import RUN, running, running_sql
from logsluice.plans.queries_pii import pii_spans_empty_matches
from logsluice.sources import rendered as R


def test_lines_of_one_file_are_searched_by_many_tasks(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("s").alias("c_mktsegment")).coalesce(
        1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for lines in (R.customer_notes, R.customer_contacts):
            tasks = lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in tasks) == 400 and len(tasks) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_without_surrogate_pairs_are_searched_plainly():
    sql = S.detect_sql("t", S.Detector("D", "a+b"), 0)
    assert "uDC00" not in sql.split("THEN")[0] and sql.count("uDC00") == 1


def test_spans_equal_a_plain_search(spark):
    rng = random.Random(5)
    parts = ["ab", "aab", " ", "b", "é", "\U0001F600", "\U00010400", "﷐", "﷑", "﷒", "x1", "12", "k=abc9"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(150))) for _ in range(200)]
    plain = {"A": r"a+b|\d{3,}", "N": r"[^a]{3,5}", "E": r"b|\S{4}"}
    detectors = [S.Detector(n, p) for n, p in plain.items()] + [S.Detector("C", r"(k=)([a-z]+\d)", "k", True, True)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", S.detect_all("t", detectors).alias("s")).collect():
        text = re.sub("[﷐-﷒]", "�", r["t"])
        want = [(m.start(), m.end(), n, m[0]) for n, p in plain.items() for m in re.finditer(p, text) if len(m[0].strip(" ")) >= 3]
        want += [(m.start(2), m.end(2), "C", m[2]) for m in re.finditer(r"(k=)([a-z]+\d)", text)]
        assert sorted((s["start"], s["end"], s["type"], s["text"]) for s in r["s"]) == sorted(want)


def test_running_totals_of_any_length(spark):
    sizes = [0, 1, 2, RUN - 1, RUN, RUN + 1, 5 * RUN, 9 * RUN + 3, 40 * RUN + 7]
    rng = random.Random(6)
    data = [(i, [rng.randrange(100) for _ in range(n)]) for i, n in enumerate(sizes)] + [(99, None)]
    got = spark.createDataFrame(data, "i int, v array<int>").select(
        "v", F.expr(running_sql("v")).alias("sql"), running(F.col("v")).alias("sum"),
        running(F.col("v"), lambda x, y: F.greatest(x, y)).alias("top")).collect()
    for r in got:
        v = r["v"]
        sums = None if v is None else [sum(v[:i + 1]) for i in range(len(v))]
        assert r["sql"] == sums and r["sum"] == sums
        assert r["top"] == (None if v is None else [max(v[:i + 1]) for i in range(len(v))])


def test_places_of_spans_are_cut_from_blocks(spark, tmp_path):
    """A substring of a long text starts at its front: with a span per word that is quadratic."""
    text = "w\u00f6rd 1234 z \U0001F600 " * 300
    spark.createDataFrame([(i, text, "s", "l") for i in range(4)], "doc_id long, text string, source string, lang string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = pii_spans_empty_matches(spark, str(tmp_path))
    assert "substring(text" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["placed"], r["replaced"]) for r in found.collect()] == [(True, True)] * 4
