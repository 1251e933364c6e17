"""Time formats by elimination: literal cases, ambiguity, plans."""

from __future__ import annotations

import pytest

from logsluice.operators import time_induction as T

RANGE = {"earliest": "2000-01-01", "latest": "2030-01-01"}
CASES = {
    "settled by a later line": (["03/04/2024 10:00 a", "x 17/04/2024 11:00"], "settled", ["DMY"]),
    "month first": (["03/04/2024", "[04/17/2024 1:02:03 PM]"], "settled", ["MDY"]),
    "nothing settles it": (["03/04/2024", "05/06/2024"], "ambiguous", ["DMY", "MDY"]),
    "contradiction": (["17/04/2024", "04/17/2024"], "unknown", []),
    "year in front": (["2024.02.03 01:02:03,456", "2024.02.29"], "settled", ["YMD"]),
    "two digits": (["31.12.24", "01.02.25"], "settled", ["DMY"]),
    "no such day": (["29.02.23", "02.03.24"], "settled", ["YMD"]),
    "seconds": (["t=1700000000.25 ok"], "settled", ["seconds"]),
    "millis": (["t=1700000000123 ok"], "settled", ["millis"]),
    "micros": (["1700000000123456"], "settled", ["micros"]),
    "nanos": (["1700000000123456789"], "settled", ["nanos"]),
    "a number that is no time": (["id 123456789012"], "unknown", []),
    "addresses and nothing": (["10.1.2.3 GET", "", None, "1/2 3:4"], None, None),
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(kind, raw) for kind, (raws, _, _) in CASES.items() for raw in raws]
    return spark.createDataFrame(rows, "sourcetype string, raw string")


def test_verdicts(lines):
    found = {r["sourcetype"]: r for r in T.formats(lines, **RANGE).collect()}
    for kind, (raws, verdict, left) in CASES.items():
        if verdict is None:
            assert kind not in found
            continue
        row = found[kind]
        assert (row["verdict"], sorted(row["formats"]), row["lines"]) == (verdict, left, len(raws)), kind
    assert found["settled by a later line"]["struck"] == {"MDY": 1}


def test_times(spark, lines):
    def text(row):
        return row["event_time"] and row["event_time"].isoformat(" ")

    read = {r["raw"]: r for r in T.read_times(lines, T.formats(lines, **RANGE)).collect()}
    assert text(read["x 17/04/2024 11:00"]) == "2024-04-17 11:00:00"
    assert text(read["03/04/2024 10:00 a"]) == "2024-04-03 10:00:00"
    assert text(read["[04/17/2024 1:02:03 PM]"]) == "2024-04-17 13:02:03"
    assert text(read["31.12.24"]) == "2024-12-31 00:00:00"
    assert text(read["t=1700000000.25 ok"]) == "2023-11-14 22:13:20.250000"
    assert text(read["1700000000123456789"]) == "2023-11-14 22:13:20.123456"
    assert text(read["2024.02.03 01:02:03,456"]) == "2024-02-03 01:02:03.456000"
    assert read["05/06/2024"]["event_time"] is None and read["05/06/2024"]["time_verdict"] == "ambiguous"
    assert read["10.1.2.3 GET"]["time_verdict"] == "none" and read[None]["time_verdict"] == "none"
    preferred = T.read_times(lines, T.formats(lines, **RANGE), prefer=["MDY"]).filter("raw = '05/06/2024'").first()
    assert (text(preferred), preferred["time_format"]) == ("2024-05-06 00:00:00", "MDY")


def test_tolerance_zone_and_missing_sourcetype(spark):
    rows = [(None, f"{d:02d}/04/2024 12:00:00.5 +0200") for d in range(1, 30)] + [(None, "04/31/2024")]
    lines = spark.createDataFrame(rows, "sourcetype string, raw string")
    assert T.formats(lines, **RANGE).first()["verdict"] == "unknown"
    found = T.formats(lines, tolerance=0.05, **RANGE)
    assert found.first()["formats"] == ["DMY"]
    read = T.read_times(lines, found).filter("raw LIKE '29/%'").first()
    assert read["event_time"].isoformat(" ") == "2024-04-29 10:00:00.500000"
    assert T.formats(lines.limit(0)).count() == 0


def test_plan_has_one_small_shuffle(lines):
    plan = T.formats(lines, **RANGE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
