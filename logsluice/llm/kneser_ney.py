"""Quality classifier: an interpolated modified Kneser-Ney model over characters.

The model is trained on trusted text (documents labelled good), all of it but a held-out fold. Counts
are taken per task and summed in Spark; continuation counts, discounts, context totals and the
interpolated probabilities of every order are joins of count tables in Spark. For scoring the
probability table is cut into shards of at most ``shard_entries`` rows by the two characters before
the predicted one, so that every back-off step of a position stays in one shard; each shard is
broadcast, one pass over the documents adds its part of their log-probability, the sums are written, and the shard
is given up before the next one is gathered: driver and workers hold one at a time. The shards are the stated
blocks of a table that covers everything; their number grows with the model.

Held-out trusted documents give each language a quantile of perplexity. A document above its language's
quantile times a margin is rejected; the margin spares short clean texts, whose perplexity varies most. A
language with few held-out documents, or none, takes the spread around its centre from all languages together, and
its centre is drawn towards theirs.

Characters keep 12 bits: code points below U+0800 have an id each, others share the 2,046 ids above,
dealt by a hash. A document starts with a start symbol, which is never predicted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from logsluice.llm.common import cut, small, text_pieces

ORDER = 5
CHAR_BITS = 12
PLAIN_CODES = 0x800
SHARD_ENTRIES = 4_000_000
HOLDOUT_FOLDS = 5
QUANTILE = 0.995
MARGIN = 1.5
MIN_HELD_OUT = 30
# The centre of all languages counts as so many documents of each.
PRIOR_DOCUMENTS = 2
# Distinct n-grams of pieces that a task holds before it merges them, unless its own are more.
MERGE_AT = 1 << 20
QUANTILE_ACCURACY = 10_000
_ORDER_SHIFT = ORDER * CHAR_BITS
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHARD_MIX = 40_503


# --- characters and n-grams -----------------------------------------------------------------------

def char_ids(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind each other, ``order - 1`` start symbols (0) before each, and lengths."""
    codes = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    pad = np.zeros(order - 1, np.uint32)
    flat = np.concatenate([x for c in codes for x in (pad, c + np.uint32(1))]) if codes else pad[:0]
    high = flat > PLAIN_CODES
    if high.any():
        room = (1 << CHAR_BITS) - PLAIN_CODES - 2
        flat[high] = PLAIN_CODES + 1 + flat[high] * np.uint32(2654435761) % np.uint32(room)
    return flat.astype(np.int64), lengths


def ngram_codes(ids: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each id, packed; the first ``order - 1`` places are left out."""
    size = max(0, len(ids) - order + 1)
    out = np.zeros(size, np.int64)
    for j in range(order):
        out <<= CHAR_BITS
        out |= ids[j:j + size]
    return out


def real_places(ids: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """Which n-grams of ``ngram_codes`` predict a character, not a start symbol."""
    return ids[order - 1:] > 0 if len(ids) else np.zeros(0, bool)


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every, where = np.unique(np.concatenate(codes), return_inverse=True)
        return every, np.bincount(where, np.concatenate(counts)).astype(np.int64)

    for batch in batches:
        for _, _, texts in text_pieces(batch, "text"):
            ids, lengths = char_ids(texts)
            found = ngram_codes(ids, ORDER)[real_places(ids, lengths, ORDER)]
            every, n = np.unique(found, return_counts=True)
            codes.append(every), counts.append(n)
            held += len(every)
            if held > MERGE_AT:
                every, n = merged()
                codes, counts, held = [every], [n], len(every) // 2
    if codes:
        every, n = merged()
        for at in range(0, len(every), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(every[at:at + (1 << 16)]), pa.array(n[at:at + (1 << 16)])], ["code", "n"])


# --- the model, as tables ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Discounts:
    one: float
    two: float
    more: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> Discounts:
    """The modified Kneser-Ney discounts from counts of counts; fixed ones where they can't be told."""
    if not (n1 and n2 and n3 and n4):
        return Discounts(0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return Discounts(*(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)))


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame | None:
    """``(key, logp, gamma)``: the packed n-gram with its order, its interpolated log-probability, and
    the log of its back-off weight as a context. ``key`` is ``order << 60 | n-gram``; a NULL ``logp`` marks
    a context only, a NULL ``gamma`` an n-gram that is no context. None if there is no text.
    """
    texts = trusted.select(F.col(text_col).cast("string").alias("text"))
    counted = cut(texts.mapInArrow(_count_ngrams, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("c")))
    grams = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):
        shorter = grams[k + 1].groupBy(F.col("code").bitwiseAND((1 << k * CHAR_BITS) - 1).alias("code"))
        grams[k] = shorter.agg(F.count("*").alias("c"))
    tagged = None
    for k in range(1, ORDER + 1):
        part = grams[k].select(F.lit(k).alias("k"), "code", "c")
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged = cut(tagged)
    ones = {r["k"]: r for r in tagged.groupBy("k").agg(*[
        F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).collect()}
    if ORDER not in ones:
        return None
    model, lower = None, None
    for k in range(1, ORDER + 1):
        d = discounts(*(ones[k][f"n{i}"] for i in range(1, 5)))
        rows = tagged.filter(F.col("k") == k).select("code", "c", F.shiftright("code", CHAR_BITS).alias("context"))
        off = F.when(F.col("c") == 1, d.one).when(F.col("c") == 2, d.two).otherwise(d.more)
        stats = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum(off).alias("taken"))
        stats = stats.withColumn("weight", F.col("taken") / F.col("total"))
        rows = rows.join(stats, "context")
        if lower is None:
            below = F.lit(1.0 / (1 << CHAR_BITS))
        else:
            rows = rows.withColumn("tail", F.col("code").bitwiseAND((1 << (k - 1) * CHAR_BITS) - 1)).join(
                lower, "tail")
            below = F.col("below")
        rows = rows.select("code", ((F.col("c") - off) / F.col("total") + F.col("weight") * below).alias("p"))
        if k < ORDER:
            rows = cut(rows)
        lower = rows.select(F.col("code").alias("tail"), F.col("p").alias("below"))
        entries = rows.select(
            (F.lit(k).cast("long") * (1 << _ORDER_SHIFT) + F.col("code")).alias("key"), F.log("p").alias("logp"))
        contexts = stats.select(
            (F.lit(k - 1).cast("long") * (1 << _ORDER_SHIFT) + F.col("context")).alias("key"),
            F.log("weight").alias("gamma"))
        both = entries.select("key", "logp", F.lit(None).cast("double").alias("gamma")).unionByName(
            contexts.select("key", F.lit(None).cast("double").alias("logp"), "gamma"))
        model = both if model is None else model.unionByName(both)
    return cut(model)


# --- lookup tables of one shard -----------------------------------------------------------------------

class HashTable:
    """Values by 60-bit keys with open addressing; lookups of whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]] = keys[left[first]]
            self.values[slot[first]] = values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value or 0."""
        slot = self._slots(keys)
        at = self.keys[slot]
        found = at == keys
        values = np.where(found, self.values[slot], np.float32(0))
        open_ = np.flatnonzero(~found & (at != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            values[open_[hit]] = self.values[slot[open_[hit]]]
            found[open_[hit]] = True
            open_ = open_[~hit & (at != -1)]
        return found, values


class Shard:
    """The part of the model for positions whose two characters before fall into shard ``number``.

    It travels as plain arrays; each worker builds its lookup tables once.
    """

    def __init__(self, number: int, count: int, entries: tuple, contexts: tuple):
        self.number, self.count = number, count
        self.rows, self.tables = (entries, contexts), None
        self.floor = np.float32(-CHAR_BITS * np.log(2))

    def ready(self) -> Shard:
        if self.tables is None:
            self.tables = [HashTable(*rows) for rows in self.rows]
            self.rows = None
        return self

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each n-gram, given those before."""
        logp, gamma = self.tables
        out = np.zeros(len(codes), np.float32)
        open_ = np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            tail = codes[open_] & ((1 << k * CHAR_BITS) - 1)
            found, value = logp.find(tail | (k << _ORDER_SHIFT))
            out[open_[found]] += value[found]
            open_, tail = open_[~found], tail[~found]
            if not len(open_):
                return out
            _, weight = gamma.find((tail >> CHAR_BITS) | ((k - 1) << _ORDER_SHIFT))
            out[open_] += weight
        out[open_] += self.floor
        return out


def shard_of(two: np.ndarray, count: int) -> np.ndarray:
    return (two * _SHARD_MIX >> 8) % count


def _shard_number(key, count: int):
    """The shard of a model row, in Spark; NULL for the rows that every shard needs."""
    order = F.shiftright(key, _ORDER_SHIFT)
    code = key.bitwiseAND((1 << _ORDER_SHIFT) - 1)
    two = F.when(F.col("logp").isNotNull(), F.shiftright(code, CHAR_BITS)).otherwise(code).bitwiseAND(
        (1 << 2 * CHAR_BITS) - 1)
    deep = order >= F.when(F.col("logp").isNotNull(), 3).otherwise(2)
    return F.when(deep, F.pmod(F.shiftright(two * F.lit(_SHARD_MIX), 8), F.lit(count)))


def shards(model: DataFrame | None, shard_entries: int = SHARD_ENTRIES) -> Iterator[Broadcast]:
    """The model's shards, broadcast one by one; each has about ``shard_entries`` rows."""
    if model is None:
        return
    count = max(1, -(-model.count() // shard_entries))
    placed = model.withColumn("shard", _shard_number(F.col("key"), count))
    for s in range(count):
        own = placed.filter(F.col("shard").isNull() | (F.col("shard") == s))
        rows = [_arrays(own.filter(F.col(v).isNotNull()).select("key", F.col(v).cast("float"))) for v in ("logp", "gamma")]
        yield model.sparkSession.sparkContext.broadcast(Shard(s, count, *rows))


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys, values = rows.toArrow().columns
    return keys.to_numpy(), values.to_numpy()


# --- scoring --------------------------------------------------------------------------------------

def _scored(batches: Iterator[pa.RecordBatch], part: Broadcast) -> Iterator[pa.RecordBatch]:
    shard = part.value.ready()
    for batch in batches:
        total, places = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for lo, hi, texts in text_pieces(batch, "text"):
            ids, lengths = char_ids(texts)
            real = real_places(ids, lengths, ORDER)
            codes = ngram_codes(ids, ORDER)[real]
            score = np.zeros(len(codes))
            if shard.count == 1:
                score = shard.score(codes)
            else:
                own = shard_of((codes >> CHAR_BITS) & ((1 << 2 * CHAR_BITS) - 1), shard.count) == shard.number
                score[own] = shard.score(codes[own])
            sums = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
            ends = np.cumsum(lengths)
            total[lo:hi] = sums[ends] - sums[ends - lengths]
            places[lo:hi] = lengths
        old = batch.column("logp").to_numpy(zero_copy_only=False)
        names = batch.schema.names
        columns = [batch.column(n) for n in names]
        columns[names.index("logp")] = pa.array(total + old)
        columns[names.index("chars")] = pa.array(places)
        yield pa.RecordBatch.from_arrays(columns, names)


def _sums(docs: DataFrame, parts: Sequence[Broadcast], keys: Sequence[str], text_col: str) -> DataFrame:
    """``keys``, and the log-probability ``logp`` that the parts add for ``chars`` characters."""
    rows = docs.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).cast("string").alias("text"),
        F.lit(0.0).alias("logp"), F.lit(0).cast("long").alias("chars"))
    for part in parts:
        rows = rows.mapInArrow(partial(_scored, part=part), rows.schema)
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "logp", "chars")


def _per_character(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    value = F.when(F.col("chars") > 0, F.exp(-F.col("logp") / F.col("chars")))
    return sums.select(*keys, "chars", value.alias("perplexity"))


def perplexity(
    docs: DataFrame, parts: Sequence[Broadcast], keys: Sequence[str], text_col: str = "text",
) -> DataFrame:
    """``keys``, ``chars`` and ``perplexity`` per character; NULL without text or without shards."""
    return _per_character(_sums(docs, parts, keys, text_col), keys)


def perplexity_by_shards(
    docs: DataFrame, model: DataFrame | None, keys: Sequence[str], shard_entries: int = SHARD_ENTRIES,
    text_col: str = "text",
) -> DataFrame:
    """As ``perplexity``, written, with one shard of the model at a time.

    Sums of several shards are kept per text, by its digest, so that equal rows need not be told apart.
    """
    if model is None:
        return perplexity(docs, [], keys, text_col)
    if model.count() <= shard_entries:
        for part in shards(model, shard_entries):
            out = cut(perplexity(docs, [part], keys, text_col))
            part.destroy()
            return out
    rows = docs.withColumn("_digest", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    total = None
    for part in shards(model, shard_entries):
        each = _sums(rows, [part], ["_digest"], text_col).groupBy("_digest").agg(
            F.max("logp").alias("logp"), F.max("chars").alias("chars"))
        if total is not None:
            each = total.unionByName(each).groupBy("_digest").agg(F.sum("logp").alias("logp"), F.max("chars").alias("chars"))
        total = cut(each)
        part.destroy()
    return cut(_per_character(rows.select(*keys, "_digest").join(total, "_digest"), keys))


# --- the classifier ------------------------------------------------------------------------------------

def _fold(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(HOLDOUT_FOLDS))


def thresholds(
    held_out: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN,
) -> tuple[DataFrame, float | None]:
    """``(lang, threshold)`` from perplexities of held-out trusted documents, one row per language, and the
    threshold of languages that have none of them; None if there is no such document at all.

    A language with at least ``MIN_HELD_OUT`` of them has a quantile of its own. For the others the quantile is
    that of perplexity over the language's centre, in all languages; the centre is the mean logarithm, with that of
    all documents added ``PRIOR_DOCUMENTS`` times.
    """
    held = cut(held_out.filter(F.col("perplexity").isNotNull()).select(
        F.col("lang").alias("_of"), F.col("perplexity").alias("p")))
    everything = held.agg(F.avg(F.log("p"))).first()[0]
    if everything is None:
        return held.select(F.col("_of").alias("lang"), F.col("p").alias("threshold")), None
    per = small(cut(held.groupBy("_of").agg(
        F.percentile_approx("p", quantile, QUANTILE_ACCURACY).alias("q"), F.count("*").alias("n"),
        F.sum(F.log("p")).alias("logs")).select(
        F.col("_of").alias("lang"), "q", "n", F.exp((F.col("logs") + PRIOR_DOCUMENTS * everything) / (
            F.col("n") + PRIOR_DOCUMENTS)).alias("centre"))))
    spread = held.join(per, F.col("_of").eqNullSafe(F.col("lang"))).agg(
        F.percentile_approx(F.col("p") / F.col("centre"), quantile, QUANTILE_ACCURACY)).first()[0]
    own = F.when(F.col("n") >= MIN_HELD_OUT, F.col("q")).otherwise(F.col("centre") * spread)
    return per.select("lang", (own * margin).alias("threshold")), float(np.exp(everything)) * spread * margin


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    good: str = "quality = 1", shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """One row per document: ``(id, lang, chars, perplexity, threshold, kept)``.

    ``labels`` has ``id_col`` and what the condition ``good`` reads; NULLs are not good. A document is
    kept unless its perplexity is above its language's threshold. NULL or empty text has no
    perplexity and is kept, as is everything if no text is trusted; NULL is a language of its own. Repeated rows
    are scored each. Labels of absent documents are ignored. Columns not named here are not read.
    """
    trusted = small(cut(labels.filter(good).select(F.col(id_col).alias("_good")).distinct()))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"))
    good_rows = rows.join(trusted, rows["id"] == F.col("_good"), "left_semi")
    scored = perplexity_by_shards(rows, train(good_rows.filter(_fold("id") != 0)), ["id", "lang"], shard_entries)
    held = scored.join(trusted, scored["id"] == F.col("_good"), "left_semi").filter(_fold("id") == 0)
    limits, rest = thresholds(held)
    limits = small(cut(limits.select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own"))), 100_000)
    judged = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn(
        "threshold", F.coalesce("_own", F.lit(rest).cast("double"))).drop("_lang", "_own")
    return judged.withColumn("kept", ~F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all their columns.

    An id whose rows are judged differently loses only if all its rows are rejected; rows without an id stay.
    """
    judged = classify(docs, labels, id_col, **options)
    gone = judged.groupBy("id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept AND id IS NOT NULL")
    gone = small(cut(gone.select(F.col("id").alias("_gone"))))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
