"""Registered queries against their SQL, and the odd inputs that every operator must answer."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsluice.llm import (
    chat, decontaminate, kneser_ney, licenses, mixing, personal, quality_rules, secrets_scan, simhash, warc)
from logsluice.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), ORACLES[name], connect(folder)) == []


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


LONG = "lorem ipsum dolor under the MIT License a@b.co " * 4000
ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, LONG, None, "s"), (4, LONG, None, "s"),
    (None, "Call +1 555 123 4567 now", "de", None), (5, "é\U0001F600 a b ÀB", "fr", "s"), (6, "x", "xx", "t"),
    (6, "y", "xx", "t"), (7, "password = hunter2hunter2 " * 3, "en", "s")]
DOCS = "doc_id long, text string, lang string, source string"


def odd(spark, rows=ODD):
    """Odd rows under clashing names."""
    clash = {c: F.lit("clash") for c in (
        "id", "key", "fp", "row", "words", "hash", "spans", "n_words", "label", "score", "stratum", "_gone", "_good",
        "_bucket", "mix_rate", "rules", "low", "grams", "perplexity", "component_id", "n", "kept", "template", "doc", "copies", "rate", "u", "copy", "_id", "_stays", "_fp", "_key", "root", "shared_id")}
    return spark.createDataFrame(rows, DOCS).withColumns({"n_chars": F.length("text"), **clash})


def labels(spark, rows=((1, 1, 0), (2, None, 1), (4, 1, 0), (4, 1, 0), (None, 1, 0), (99, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "lorem ipsum dolor under the mit license a b co lorem"), (None, None), (2, ""), (3, "call"), (3, "call"))):
    return spark.createDataFrame(list(rows), "item_id long, text string").withColumn("pattern", F.lit(1))


SCANS = {
    "decontaminate": lambda s, d: decontaminate.contamination(d, items(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "personal": lambda s, d: personal.find_spans(d),
    "secrets": lambda s, d: secrets_scan.scan(d),
    "kneser_ney": lambda s, d: kneser_ney.classify(d, labels(s)),
    "quality_rules": lambda s, d: quality_rules.judge(d, labels(s)),
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_odd_rows(spark, name):
    rows = SCANS[name](spark, odd(spark)).collect()
    ids = sorted((r["id"] for r in rows), key=str)
    assert ids == sorted((r[0] for r in ODD), key=str)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["id"], []).append(r)
    assert by_id[4][0] == by_id[4][1]
    if name == "decontaminate":
        assert by_id[4][0]["items"] == ["1"] and not by_id[1][0]["contaminated"] and by_id[None][0]["items"] == ["3"]
    if name == "licenses":
        assert by_id[4][0]["n_base"] == 4000 and by_id[1][0]["n_words"] == 0 and by_id[2][0]["labels"] == []
    if name == "simhash":
        assert {r["component_id"] for i in (1, 2, 3) for r in by_id[i]} == {1} and by_id[1][0]["fp"] == 0
    if name == "personal":
        assert len(by_id[4][0]["spans"]) == 4000 and by_id[None][0]["spans"][0]["kind"] == "phone"
    if name == "secrets":
        assert [s["kind"] for s in by_id[7][0]["spans"]] == ["assign"] * 3
    if name == "quality_rules":
        assert by_id[1][0]["base_failed"] and by_id[5][0]["word_chars"] == 7


@pytest.mark.parametrize("name", sorted(SCANS))
def test_empty_table(spark, name):
    assert SCANS[name](spark, odd(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["decontaminate", "kneser_ney", "quality_rules"])
def test_empty_partner(spark, name):
    docs = odd(spark)
    rows = {
        "decontaminate": lambda: decontaminate.contamination(docs, items(spark, [])),
        "kneser_ney": lambda: kneser_ney.classify(docs, labels(spark, [])),
        "quality_rules": lambda: quality_rules.judge(docs, labels(spark, []))}[name]().collect()
    assert len(rows) == len(ODD)
    if name == "kneser_ney":
        assert all(r["kept"] and r["perplexity"] is None for r in rows)


def test_odd_stages(spark, tmp_path):
    """Each stage keeps the columns and takes odd and empty tables."""
    folder = str(tmp_path)
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    items(spark).write.parquet(f"{folder}/benchmark.parquet")
    for rows in (ODD, []):
        docs = odd(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "mixture":
                assert out.columns == docs.columns
                assert out.dtypes == docs.dtypes
            if not rows:
                assert out.count() == 0
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(ODD, DOCS), folder)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "6", "7", "None"])
    copies = spark.createDataFrame(
        [(None, "a b"), (None, "a b"), (None, "c d"), (3, "c d"), (3, "c d"), (4, "a b"), (5, "e"), (None, "f g"), (3, "h")], "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, copies, folder).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [
        ("3", "c d"), ("3", "h"), ("4", "a b"), ("5", "e"), ("None", "f g")]


def test_odd_conversations(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 1, "assistant", "<turn>\\l"), (2, 0, "user", ""),
         (None, 3, "tool\nx", "y")], "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    canonical = chat.canonical_turns(chat.records_of(rows))
    got = {r["id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in canonical.collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a")], 2: [("user", ""), ("assistant", "<turn>\\l")],
                   None: [("tool\nx", "y")]}
    back = {r["id"]: r for r in chat.read_back(chat.format_turns(canonical)).collect()}
    assert back[2]["loss_chars"] == len("<turn>\\l") and back[1]["loss_chars"] == 0 and back[1]["n_turns"] == 3
    assert chat.read_back(chat.format_turns(chat.canonical_turns(chat.records_of(rows.limit(0))))).collect() == []


def test_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b/c", "x"), (2, None, "x"), (2, None, "x"), (3, "http://a.b/c\r\nWARC-Type: x", None), (4, "::", ""),
         (None, "http://[bad", "z"), (5, "http://a.b/long", "é" * 3_000_000)],
        "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    rows = warc.archive_and_read(pages).collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    assert got == [("1", 1, "revisit", 2), ("2", 1, "response", None), ("2", 1, "response", None), ("3", 0, "revisit", 4),
                   ("4", 0, "response", None), ("5", 6_000_000, "response", None), ("None", 1, "response", None)]
    assert warc.archive_and_read(pages.limit(0)).collect() == []


def test_odd_mixture(spark):
    docs = odd(spark)
    mixed = mixing.mix(docs, {"s": 1.0}, rest=1.0, size=3.0)
    rows = mixed.collect()
    assert {r["mix_rate"] for r in rows} != {"clash"}
    assert [r["mix_order"] for r in mixed.filter("doc_id = 4").collect()]
    per_row = {}
    for r in rows:
        per_row[(r["doc_id"], r["text"])] = per_row.get((r["doc_id"], r["text"]), 0) + 1
    assert per_row.get((4, LONG), 0) % 2 == 0
    assert mixing.mix(odd(spark, []), {"s": 1.0}, 1.0).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s": -1.0}, 1.0)
