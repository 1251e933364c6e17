"""The divergence of sources against a plain computation over all terms."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsluice.llm import divergence as D

DOCS = "doc_id long, text string, lang string, source string"


def slow_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or c > "\x7f":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def expected(rows, min_docs, top):
    uses, groups, holders = defaultdict(Counter), set(), Counter()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        uses[lang, source].update(slow_terms(text))
        holders.update({(lang, t) for t in slow_terms(text)})
    out = set()
    for lang, source in groups:
        kept = [t for (a, t), n in holders.items() if a == lang and n >= min_docs]
        peers = [s for a, s in groups if a == lang]

        def share(counts, t):
            return 1 + 10 ** 9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept))

        def apart(a, b):
            return (a - b) ** 2 // (a + b)

        whole = sum((uses[lang, s] for s in peers), Counter())
        own = {t: share(uses[lang, source], t) for t in kept}
        parts = {"pair": [(sum(apart(own[t], share(uses[lang, s], t)) for t in kept), s) for s in peers if s != source],
                 "term": [(apart(own[t], share(whole, t)), t) for t in kept
                          if uses[lang, source][t] and own[t] > share(whole, t)]}
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            for rank, (value, item) in enumerate(found[:None if part == "pair" else top], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def corpus(n=300):
    rng = random.Random(8)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["É", "ÀB", "the"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(6)}"
        words = rng.choices(vocabulary, [2 + (hash_ % 7 == len(source)) * 9 for hash_ in range(63)], k=rng.randrange(60))
        rows.append((i, "-".join(words), rng.choice(["en", "en", "de", None]), source))
    return rows + [(900, None, "en", None), (901, "the The THE", None, "only"), (902, "rare", "xx", "a"), (903, "", "xx", "b"),
                   (904, "", "yy", "b"), (905, "the\x00the\u00a0x", "en", "")]


def rows_of(frame):
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect()}


@pytest.mark.parametrize("held,peers,gather", [(D.HELD_POSTINGS, D.PEERS, D.GATHER), (3, 2, 2)])
def test_against_all_terms(spark, monkeypatch, held, peers, gather):
    """Also in slices and peer rows so small that every border is met."""
    monkeypatch.setattr(D.against_baselines, "__defaults__", (peers,))
    monkeypatch.setattr(D.common_terms, "__defaults__", (held, held))
    monkeypatch.setattr(D.Accumulators.add, "__defaults__", (gather,))
    rows = corpus()
    got = D.audit(spark.createDataFrame(rows, DOCS), min_docs=5, top_terms=3)
    assert rows_of(got) == expected(rows, 5, 3)


def test_repeated_rows_long_texts_and_clashing_names(spark):
    rows = corpus(60) * 2 + [(7, "ab cd " * 60_000, "en", "long")]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("term", "n", "docs", "item", "value", "rank", "part", "p", "peers", "v"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert rows_of(D.audit(frame, min_docs=3)) == expected(rows, 3, 10)


def test_empty_and_no_kept_terms(spark):
    empty = spark.createDataFrame([], DOCS)
    assert D.audit(empty).collect() == []
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "en", None), (4, "a", "de", "x")]
    got = rows_of(D.audit(spark.createDataFrame(rows, DOCS)))
    assert got == expected(rows, 10, 10) and len(got) == 6 and {r[4] for r in got} == {0}


def test_counts_past_64_bits(spark):
    counts = [
        ("en", "a", "the", 4 * 10 ** 12, 20), ("en", "b", "the", 10 ** 12, 10), ("en", "b", "of", 7 * 10 ** 12, 10)]
    counts = spark.createDataFrame(counts, D.COUNTS)
    _, every = D.shares(counts.select("lang", "source").distinct(), counts)
    got = {(r["source"], r["term"]): (r["p"], r["q"]) for r in every.collect()}
    assert got["b", "of"] == (1 + 10 ** 9 * (7 * 10 ** 12 + 2) // (8 * 10 ** 12 + 4),
                              1 + 10 ** 9 * (7 * 10 ** 12 + 2) // (12 * 10 ** 12 + 4))
    assert got["a", "the"][0] == 1 + 10 ** 9 * (4 * 10 ** 12 + 2) // (4 * 10 ** 12 + 4)


def test_counting_task_gives_up_what_it_holds():
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["s"] * 4, "text": ["a b", "b c", "", "c c d"]})
    small, large = (Counter(), Counter())
    for limit, total in ((1, small), (100, large)):
        for out in D._count(iter([batch]), limit):
            for r in out.to_pylist():
                if r["term"]:
                    total.update({(r["term"], "n"): r["n"], (r["term"], "docs"): r["docs"]})
    assert small == large == {("a", "n"): 1, ("a", "docs"): 1, ("b", "n"): 2, ("b", "docs"): 2, ("c", "n"): 3, ("c", "docs"): 2,
                              ("d", "n"): 1, ("d", "docs"): 1}
    assert D.summand(np.array([10 ** 9 + 1]), np.array([1])).tolist() == [(10 ** 9) ** 2 // (10 ** 9 + 2)]
