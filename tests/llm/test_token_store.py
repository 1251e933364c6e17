"""Token shards and their index: against the tokenizer itself, round trips, keyed access."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsluice.llm import token_store as T
from logsluice.llm.queries import QUERIES, tokenizer_file

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def expected(rows, tokenizer, end=0):
    """Rows of one document per id, in order."""
    out, start = {}, 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def got(frame, key="id", n="n"):
    return {r[key]: (r["start"], r[n], r["ids_crc32"]) for r in frame.collect()}


WHITE = [" ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", "\u00a0", "\u2003", "\u200b", "\x85", "\x1c", "\u3000", "\ufeff", "\x0b"]
WORDS = ["a", "Word", "it's", "'s", "12", "é", "中文", "\U0001F600", ",", "...", "-", "<|endoftext|>", "\x00", "ñandú", "x" * 90, "\u0301", "\u0600"]


def test_pieces_do_not_change_the_ids(tokenizer):
    rng, encoder = random.Random(5), T.Encoder(tokenizer_file())
    for i in range(4000):
        text = "".join(rng.choice(WHITE if rng.random() < 0.5 else WORDS) for _ in range(rng.randrange(14)))
        assert "".join(T.pieces_of(text)) == text
        both = encoder.ids([text, " " + text])
        for t, raw in zip((text, " " + text), both):
            assert np.frombuffer(raw, np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    spelled = T.Encoder(tokenizer_file(), special_as_text=True).ids(["<|endoftext|>"])[0]
    assert len(spelled) > 4 and np.frombuffer(encoder.ids(["<|endoftext|>"])[0], np.uint32).tolist() == [50256]
    assert encoder.ids([]) == [] and encoder.ids(["", "a"])[0] == b""


def test_long_texts_go_in_segments(tokenizer, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(WORDS) + rng.choice(WHITE) for _ in range(30_000))
    assert "".join(T.segments(text, 100)) == text and len(list(T.segments(text, 100))) > 300
    monkeypatch.setattr(T.segments, "__defaults__", (500,))
    monkeypatch.setattr(T, "SEGMENT", 700)
    monkeypatch.setattr(T, "CACHED_PIECES", 50)
    encoder = T.Encoder(tokenizer_file())
    assert np.frombuffer(encoder.ids([text])[0], np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.cache) < 1000
    assert list(T.segments("x" * 1000, 10)) == ["x" * 1000]


@pytest.mark.parametrize("n", [0, 1, 63, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = rng.permutation(np.concatenate([np.arange(n // 2), rng.integers(-2 ** 63, 2 ** 63 - 1, n - n // 2)]))
    null = np.zeros(n, bool)
    if n > 1:
        null[3 % n] = True
    a, b = T.key_hashes(keys, null)
    perfect = T.PerfectHash.build(a, b)
    found = perfect.find(a, b)
    assert perfect.size == n and sorted(found.tolist()) == list(range(n))
    assert sum(64 * len(x) for x in perfect.levels) <= 5 * n + 64 * 40
    slots = np.zeros(n, T._SLOT)
    slots["print"][found] = T._prints(a, b)
    again, back, runs = T.load_part(T.dump_part(perfect, slots, np.zeros(2, T._RUN)))
    assert (again.find(a, b) == found).all() and (back == slots).all() and len(runs) == 2
    others = T.key_hashes(np.arange(10 ** 12, 10 ** 12 + 100_000), np.zeros(100_000, bool))
    at = perfect.find(*others)
    hit = at >= 0
    assert (slots["print"][at[hit]] == T._prints(others[0][hit], others[1][hit])).sum() == 0
    with pytest.raises(ValueError):
        T.load_part(T.dump_part(perfect, slots, runs)[:-1])
    with pytest.raises(ValueError):
        T.load_part(b"other")


def test_query_on_the_small_table(spark, folder, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(QUERIES["op12_token_ids"](spark, folder), "doc_id", "n_tokens") == expected(rows, tokenizer)


def test_small_shards_and_index_parts(spark, tokenizer, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(-10 ** 12, 10 ** 12), " ".join(rng.choices(WORDS, k=rng.randrange(20)))) for _ in range(300)]
    rows += [(None, "no id"), (5, None), (6, ""), (7, " \n "), (8, "long text " * 50_000)]
    folder = f"file://{tmp_path}/store"
    frame = spark.createDataFrame(rows, DOCS)
    places, shards = T.write_shards(frame, folder, tokenizer_file(), shard_ids=40)
    assert shards.count() > 50
    index = T.build_index(places, folder, index_keys=20)
    assert index.count() > 10
    want = expected(rows, tokenizer)
    keys = spark.createDataFrame([(k,) for k in [None, 5, 8, rows[0][0], 10 ** 15, -3]], "id long")
    found = T.look_up(keys, index, folder)
    back = T.read_documents(found, shards, folder).collect()
    assert {r["id"]: (r["start"], r["n"], zlib.crc32(r["ids"])) for r in back} == {
        k: want[k] for k in [None, 5, 8, rows[0][0]]}
    everything = T.read_documents(T.look_up(frame.select(F.col("doc_id").alias("id")), index, folder), shards, folder)
    assert {r["id"]: (r["start"], r["n"], zlib.crc32(r["ids"])) for r in everything.collect()} == want


def test_repeated_ids_over_many_shards(spark, tokenizer, tmp_path):
    rows = [(1, f"copy {i}") for i in range(150)] + [(None, f"none {i % 3}") for i in range(60)] + [(0, "a"), (2, "b"), (2, "b")]
    folder = f"file://{tmp_path}/store"
    places, shards = T.write_shards(spark.createDataFrame(rows, DOCS), folder, tokenizer_file(), shard_ids=30)
    index = T.build_index(places, folder)
    keys = spark.createDataFrame([(k,) for k in [None, 0, 1, 2, 3]], "id long")
    back = T.read_documents(T.look_up(keys, index, folder), shards, folder).collect()
    texts = sorted((str(r["id"]), tokenizer.decode(np.frombuffer(r["ids"], "<u4")[:-1].tolist())) for r in back)
    assert texts == sorted((str(k), t) for k, t in rows)
    spans = sorted((r["start"], r["start"] + r["n"]) for r in back)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    order = [r["id"] for r in sorted(back, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))


def test_empty_table_and_clashing_names(spark, tokenizer):
    frame = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], DOCS + ", id string").withColumns(
        {c: F.lit("clash") for c in ("tie", "n", "ids", "shard", "row", "part", "file", "range")})
    assert got(T.store_and_read(frame, tokenizer_file())) == expected([(1, "a b"), (2, None)], tokenizer)
    assert T.store_and_read(frame.limit(0), tokenizer_file()).collect() == []
