"""Every language has a threshold, and the model is never held whole."""

import numpy as np

from logsluice.llm import kneser_ney as K

LETTERS = {"en": "etaoin shrdlu ", "fr": "esaitn rulodc ", None: "qwvxzk jypbgm "}


def prose(rng, lang, n=300):
    return "".join(rng.choice(list(LETTERS[lang]), n))


def languages(spark):
    """A hot language, one with few labels, one without a name; rows 5000 and up are noise, one in each language."""
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(["en"] * 260 + ["fr"] * 24 + [None] * 24)]
    bad = [(5000 + i, "".join(chr(int(c)) for c in rng.integers(0x100, 0x500, 300)), lang)
           for i, lang in enumerate(["en", "fr", None, "xx"])]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")


def test_small_and_unnamed_languages_are_filtered(spark):
    rows = K.classify(*languages(spark)).collect()
    assert all(r["threshold"] is not None for r in rows)
    assert [r["id"] for r in rows if not r["kept"] and r["id"] < 5000] == []
    assert sorted(r["id"] for r in rows if not r["kept"]) == [5000, 5001, 5002, 5003]


def test_one_shard_at_a_time(spark, monkeypatch):
    """Shards are given up before the next one is gathered, and their sums give what one shard gives."""
    docs, labels = languages(spark)
    docs = docs.unionByName(spark.createDataFrame(
        [(7, "twice", "en"), (7, "twice", "en"), (8, None, "en"), (None, "", None)], docs.schema))
    whole = K.classify(docs, labels).collect()
    made, gather = [], K.shards

    def watched(*args):
        for part in gather(*args):
            assert not any(p._jbroadcast.isValid() for p in made)
            made.append(part)
            yield part

    monkeypatch.setattr(K, "shards", watched)
    parted = K.classify(docs, labels, shard_entries=60_000).collect()
    assert len(made) > 2

    def key(r):
        return (str(r["id"]), r["chars"], r["kept"], r["perplexity"] and round(r["perplexity"], 2))

    assert sorted(map(str, map(key, parted))) == sorted(map(str, map(key, whole)))
