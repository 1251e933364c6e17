"""One scan for many rules gives what the rules give one by one, where their matches don't touch."""

import random

from pyspark.sql import functions as F

from logsluice.operators import redaction
from logsluice.operators.detectors import DETECTORS

PIECES = [
    "a@b.example.com", "10.1.2.3", "4111 1111 1111 1111", "+1 555 123 4567", "078-05-1120", "https://x.example/p?q=1", "born on 1990-01-02",
    "SMITH801015JJ9AB", "SW1A 1AA", "AB123456C", "@handle", "skype: some.user1", "password = hunter22", "AB12 CDE", "plain", "é\U0001F600"]


def both(spark, texts, rules):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", redaction.redact_patterns(F.col("t"), rules).alias("a"), redaction.redact_once(F.col("t"), rules).alias("b")).collect()
    return [(r["t"], r["a"], r["b"]) for r in rows]


def test_all_detectors(spark):
    rng = random.Random(9)
    texts = [" ; ".join(rng.choices(PIECES, k=rng.randrange(9))) for _ in range(300)] + [None, "", "none at all"]
    rules = redaction.detector_rules(list(DETECTORS))
    assert len(rules) == 15 and len(redaction.fused_groups(rules)) <= 3
    got = both(spark, texts, rules)
    assert all(a == b for _, a, b in got) and sum(t != a for t, a, _ in got) > 200
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    gated = df.select("t", redaction.redact_detectors(F.col("t"), list(DETECTORS)).alias("g")).collect()
    assert {r["t"]: r["g"] for r in gated} == {t: a for t, a, _ in got}


def test_earlier_rule_wins_and_labels_are_not_seen(spark):
    rules = [(r"\d{4}", "[FOUR]"), (r"\d{2,}", "[MANY]"), ("FOUR", "[WORD]"), (r"(?i)(?<lead>key=)(\w+)", "[K]")]
    rows = dict((t, b) for t, _, b in both(spark, ["12345 67 FOUR", "Key=abc KEY=1", "key="], rules))
    assert rows == {"12345 67 FOUR": "[FOUR]5 [MANY] [[WORD]]".replace("[[WORD]]", "[WORD]"), "Key=abc KEY=1": "Key=[K] KEY=[K]", "key=": "key="}


def test_rules_that_cannot_share_a_scan(spark):
    rules = [(r"(\w)\1{3,}", "[REPEAT]"), ("abc", "[A]"), (r"x*", "-"), ("def", "$1\\"), (r"\Qa.b\E", "[Q]"), ("ghi", "[G]")]
    assert [len(g) for g in redaction.fused_groups(rules)] == [1, 1, 1, 1, 1, 1]
    assert [len(g) for g in redaction.fused_groups([("a", "1"), ("b", "2"), (r"(c)\1", "3"), ("d", "4"), ("e", "5")])] == [2, 1, 2]
    got = both(spark, ["zzzzz abc def", "ghi a.b"], [r for r in rules if r[0] != "x*"])
    assert all(a == b for _, a, b in got)


def test_marks_in_the_text(spark):
    rows = both(spark, ["\ufdd0 abc \ufdd1\ufdd2", "abc"], [("abc", "[A]"), ("zz", "[Z]")])
    assert [b for _, _, b in rows] == ["\ufffd [A] \ufffd\ufffd", "[A]"]
