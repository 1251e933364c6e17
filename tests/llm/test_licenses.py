"""License scans: spans are accepted per copy and verified word by word."""

from __future__ import annotations

import pytest

from logsluice.llm import licenses

MIT = next(body for label, body in licenses.TEMPLATES if label == "mit")


def _without(text, *places):
    return " ".join(w for i, w in enumerate(text.split()) if i not in places)


CASES = {
    "heading and text": ("Mozilla Public License\nMozilla Public License 2.0", "mpl", [(0, 3), (3, 6)]),
    "five copies": ("mozilla public license " * 5, "mpl", [(3 * i, 3 * i + 3) for i in range(5)]),
    "half a name twice": ("gnu general public gnu general public", "", []),
    "name": ("under the GNU General Public License, version 3", "gpl", [(2, 6)]),
    "whole notice": (MIT, "mit", [(0, len(MIT.split()))]),
    "two whole notices": (f"{MIT} {MIT}", "mit", [(i * len(MIT.split()), (i + 1) * len(MIT.split())) for i in (0, 1)]),
    "words missing": (_without(MIT, 10, 30), "mit", [(0, len(MIT.split()) - 2)]),
    "words added": ("x " + MIT.replace("charge to", "charge and cost to").replace("modify merge", "modify or merge"), "mit",
                    [(1, len(MIT.split()) + 4)]),
    "every sixth word changed": (" ".join("x" if i % 6 == 5 else w for i, w in enumerate(MIT.split())), "", []),
    "half a notice": (" ".join(MIT.split()[:30]), "", []),
    "empty": ("", "", []),
    "null": (None, "", []),
}


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(name, text) for name, (text, _, _) in CASES.items()], "doc_id string, text string")
    return {r["id"]: r for r in licenses.scan(docs).collect()}


@pytest.mark.parametrize("name", CASES)
def test_labels_and_spans(scanned, name):
    _, labels, spans = CASES[name]
    row = scanned[name]
    assert ",".join(row["labels"]) == labels
    assert [(s["start"], s["end"]) for s in row["spans"]] == spans
    assert (row["score"] >= licenses.COVERAGE) == bool(spans)


def test_notice_halves_in_wrong_order_are_none(spark):
    words = MIT.split()
    docs = spark.createDataFrame([(1, " ".join(words[35:] + words[:35]))], "doc_id int, text string")
    assert licenses.scan(docs).first()["labels"] == []
