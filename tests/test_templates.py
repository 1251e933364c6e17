"""Templates learned from lines: what they read is what was written."""

import random

from pyspark.sql import functions as F

from logsluice.operators import templates as T

LINES = "event_id long, sourcetype string, raw string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(rows)], LINES).repartition(3)


def learned(spark, rows, **options):
    lines = frame(spark, rows)
    found = T.learn(lines, **options)
    return {(r["sourcetype"], r["pattern"]): r for r in found.collect()}, {
        r["event_id"]: r for r in T.read(lines, found).collect()}, found


def test_tokens_join_to_the_line_and_have_one_class(spark):
    rng = random.Random(1)
    parts = ["a", "foo-bar", "x9", "12", "-3.5", "5.", "1.2.3.4", "1.2.3", "a@b.co", "http://h/p?q=1", "/var/log", "/", '"q u"', '"',
             " ", "  ", "\t", "=", ":", "(", "--", "é", "2024-01-02T03:04:05Z", "Jan  2 03:04:05", "02/Jan/2024:03:04:05 +0000",
             "123e4567-e89b-12d3-a456-426614174000", "\U0001F600", "foo.", "9-", "<", "<word>"]
    lines = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(600)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, raw string").select(
        "i", T.tokens(F.col("raw")).alias("t")).collect()
    assert {r["i"]: "".join(t["text"] for t in r["t"]) for r in got} == dict(enumerate(lines))
    # Every line fits the pattern of its own shape, whose groups are its tokens.
    rows = [("s", x) for x in lines]
    patterns, read, found = learned(spark, rows, min_lines=10 ** 6)
    fits = frame(spark, rows).join(T.read(frame(spark, rows), found).select("event_id", "template", "fields"), "event_id").join(
        found.select("template", "pattern", "names"), "template")
    groups = fits.select("raw", "pattern", "names", "fields", F.expr("raw RLIKE pattern").alias("fits"))
    rows_ = groups.collect()
    assert len(rows_) == len(lines) and all(r["fits"] for r in rows_)
    assert all(sorted(r["names"]) == sorted(r["fields"]) for r in rows_)


def test_shapes_with_equal_classes_split_by_their_words(spark):
    rng = random.Random(2)
    users = [f"user{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        user, state = rng.choice(users), rng.choice(["ok", "failed", "late"])
        rows.append(("auth", f"login by {user} was {state}") if i % 2 else ("auth", f"disk of {user} is {state}"))
    patterns, read, _ = learned(spark, rows)
    assert len(patterns) == 2
    for i, (_, raw) in enumerate(rows):
        words = raw.split(" ")
        assert sorted(read[i]["fields"].values()) == sorted([words[2], words[4]])


def test_values_in_all_combinations_are_fields(spark):
    rows = [("web", f"{m} /p{i} {s}") for i in range(60) for m, s in [(["GET", "PUT"][i % 2], ["up", "down", "off"][i % 3])]]
    patterns, read, _ = learned(spark, rows)
    (row,) = patterns.values()
    assert row["names"] == ["word", "path", "word_2"] and row["lines"] == 60
    assert read[1]["fields"] == {"word": "PUT", "path": "/p1", "word_2": "down"}


def test_nested_splits_and_rare_lines(spark):
    rows = [("s", f"{a} {b} {c} {d}") for i in range(30) for a, b, c, d in [
        ("open", "file", "for", f"u{i}"), ("open", "socket", "on", f"u{i}"), ("close", "all", "of", f"u{i}")]]
    rows += [("s", "one lone line u1"), ("t", "one lone line u1"), (None, "x=1 y=2"), (None, "x=3 y=4")]
    patterns, read, _ = learned(spark, rows)
    by_type = {}
    for (s, _), r in patterns.items():
        by_type.setdefault(s, []).append(r)
    assert [r["names"] for r in by_type[None]] == [["x", "y"]] and read[len(rows) - 1]["fields"] == {"x": "3", "y": "4"}
    assert sum(r["lines"] for r in by_type["s"]) == 91 and all(read[i]["template"] for i in range(len(rows)))
    deep = [r for r in by_type["s"] if "open" in r["pattern"] or "close" in r["pattern"]]
    assert sorted(r["lines"] for r in deep) in ([30, 30, 30], [30, 30, 30, 1][:len(deep)])


def test_odd_lines(spark):
    rows = [("s", None), ("s", ""), ("s", " \n "), ("s", "a" * 100_000), ("s", "word " * 5000), ("s", '{"a":"b"}'), ("s", '"open')]
    patterns, read, _ = learned(spark, rows)
    assert read[0]["fields"] == read[1]["fields"] == {} and read[0]["template"] == read[1]["template"]
    assert read[4]["fields"]["rest"] == ("word " * 5000)[len("word " * 100):]
    assert all(read[i]["template"] for i in range(len(rows)))
    clash = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("tokens", "shape", "words", "key", "line", "node", "n")})
    assert T.read(clash, T.learn(clash)).filter("template IS NULL").count() == 0
    assert T.learn(frame(spark, [("s", "x")]).limit(0)).collect() == []


def test_unseen_lines_stay_without_fields(spark):
    found = T.learn(frame(spark, [("s", f"got {i} of x") for i in range(9)]))
    read = {r["raw"]: r["fields"] for r in T.read(frame(spark, [("s", "got 77 of x"), ("s", "put 1 in y"), ("t", "got 1 of x")]), found).collect()}
    assert read == {"got 77 of x": {"number": "77"}, "put 1 in y": None, "got 1 of x": None}


def test_extractions_for_a_specification(spark):
    lines = frame(spark, [("s", f"got {i} of x") for i in range(9)] + [("s", f"ip 10.0.0.{i}") for i in range(4)] + [("s", "rare one")])
    found = T.extractions(T.learn(lines))["s"]
    assert [e.names for e in found] == [("number",), ("ip",)]
    read = lines.select("raw", T.extract_any(F.col("raw"), found).alias("m")).collect()
    assert {r["raw"]: r["m"] for r in read}["ip 10.0.0.3"] == {"ip": "10.0.0.3"}
    assert {r["raw"]: r["m"] for r in read}["rare one"] is None
