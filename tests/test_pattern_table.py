"""A table of patterns finds what its patterns find one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logsluice.functions import spans as S
from logsluice.operators import pattern_table as T
from logsluice.operators.detectors import custom_detectors
from tests.test_plans import plan

PATTERNS = "name string, regex string"


def rows_of(frame):
    return sorted((r["id"], r["start"], r["end"], r["type"], r["text"]) for r in frame.collect())


def one_by_one(df, patterns):
    found = S.detect_all("text", custom_detectors(patterns))
    return rows_of(df.select("id", F.explode(found).alias("s")).select("id", "s.*"))


@pytest.mark.parametrize("pattern,literals", [
    (r"(?i)EMP\d{6}", ["emp"]), (r"foo|barbaz", ["barbaz", "foo"]), (r"fo|barbaz", None), (r"a+bcd?e", None), (r"\d+", None),
    (r"ab(cd)ef[x]+longer", ["longer"]), (r"(?:abc|de)?xyz", ["xyz"]), (r"(?:one|two|three)=\w+", ["one", "three", "two"]),
    (r"\bkey\b=", ["key="]), (r"(?P<who>user\d+)", ["user"]), (r"(?<=abc)defg", ["defg"]), (r"äöü", None), (r"(?x) a b c d", None),
    (r"(unclosed", None), (r"x{2,}yabc", ["yabc"]), (r"(?:abcd){3}", ["abcd"]), (r"a.b.c.d", None), (r"", None), (r"(?!abc)\w+", None),
    (r"\Qabc\E", None)])
def test_required_literals(pattern, literals):
    assert T.required_literals(pattern) == literals


def test_every_match_holds_a_literal():
    rng = random.Random(3)
    atoms = ["abc", "de", "xyz1", r"\d", "[a-c]+", "(?:foo|bars)", "(?:q|r)", "z?", "(qux)*", "(?:lorem){2}", r"\b", ".", "(?i:KEY)"]
    for _ in range(2000):
        pattern = "".join(rng.choices(atoms, k=rng.randrange(1, 6)))
        literals = T.required_literals(pattern)
        text = "".join(rng.choices(["abc", "de", "xyz1", "7", "a", "foo", "bars", "q", "z", "qux", "lorem", " ", "KEY", "key"], k=12))
        for m in re.finditer(pattern, text):
            assert literals is None or any(x in m[0].lower() for x in literals), (pattern, text)


def test_same_spans_as_the_detectors(spark):
    rng = random.Random(4)
    patterns = [(f"n{i % 40}", rf"item{i}\b") for i in range(150)]
    patterns += [("digits", r"\d{4,}"), ("either", r"alpha|omega\w*"), ("user", r"(?P<u>user[0-9]+)@x"), ("é", "caféx?"), (None, r"zip\d")]
    words = [f"item{i}" for i in range(200)] + ["ALPHA", "omegaX", "user12@x", "12345", "CAFÉ", "café", "\U0001F600", "zip9"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(200)] + [(900, None), (901, ""), (902, "item1 " * 2000)]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("type", F.lit("clash"))
    table = spark.createDataFrame([*patterns, *patterns[:5], ("blank", " "), ("none", None)], PATTERNS)
    assert rows_of(T.find_spans(df, ["id"], "text", table)) == one_by_one(df, patterns)


def test_blocks_and_empty_tables(spark, monkeypatch):
    patterns = [(f"n{i}", f"word{i}x") for i in range(25)]
    df = spark.createDataFrame([(i, f"word{i}x word{i + 1}x") for i in range(24)], "id long, text string")
    monkeypatch.setattr(T, "BLOCK_PATTERNS", 7)
    assert rows_of(T.find_spans(df, ["id"], "text", spark.createDataFrame(patterns, PATTERNS))) == one_by_one(df, patterns)
    nothing = T.find_spans(df, ["id"], "text", spark.createDataFrame([], PATTERNS))
    assert nothing.collect() == [] and nothing.columns == ["id", "start", "end", "ord", "type", "text", "score"]
    assert T.find_spans(df.limit(0), ["id"], "text", spark.createDataFrame(patterns, PATTERNS)).collect() == []


def test_five_thousand_patterns_without_join_or_shuffle(spark):
    table = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("code"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("[a-z]")).alias("regex"))
    df = spark.range(3000).select("id", F.concat(F.lit("see code"), F.lpad((F.col("id") * 7 % 5000).cast("string"), 4, "0"), F.lit("q and more")).alias("text"))
    found = T.find_spans(df, ["id"], "text", table)
    text = plan(found)
    assert "Join" not in text and "Exchange" not in text
    rows = rows_of(found)
    assert rows == sorted((i, 4, 13, f"N{i * 7 % 5000}", f"code{i * 7 % 5000:04d}q") for i in range(3000))
