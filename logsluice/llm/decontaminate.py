"""Benchmark decontamination: a prefix-filtered set join of item windows with document shingles.

A pattern is a run of words of a benchmark item, seen as the set of its word shingles, with the share of
them that a document window of the same length must hold. Shingles are ordered by how often they occur
in all documents; a pattern of ``m`` shingles that needs ``q`` of them can only be met where one of its
``m - q + 1`` rarest occurs, so only that prefix is joined with the documents' shingles. A candidate must
lie within its document (positions and lengths) and is then verified: word by word if all shingles are
needed, else by counting the pattern's shingles over windows of its own length.

Two kinds of patterns are made: every window of ``window`` consecutive item words, exact; and every whole
item, of whose five-word shingles ``similarity`` must occur in one window as long as the item.

Patterns come in blocks of at most about ``block_patterns``. Each block's shingle counts and prefix are
worked out in Spark, broadcast, and joined in one pass over all documents; passes add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from logsluice.llm.common import binary_column, cut, pieces, small
from logsluice.llm.words import find_words, shingle_hashes, word_hashes

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCK_PATTERNS = 200_000
_FILTER_BITS = 22

_PATTERN = "item_id long, exact boolean, words int, size int, need int, text binary, hashes array<long>"
_FOUND = ("id long, text string, n_words long, "
          "spans array<struct<start:int,words:int,item_id:long>>, near array<long>")


# --- patterns of the items --------------------------------------------------------------------------

def _item_patterns(
    batches: Iterator[pa.RecordBatch], window: int, shingle: int, similarity: float,
) -> Iterator[pa.RecordBatch]:
    def pattern(item, exact, words, hashes, begin, count):
        size = min(shingle, count)
        own = shingle_hashes(hashes[begin:begin + count], size)
        distinct = len(np.unique(own))
        need = len(own) if exact else math.ceil(similarity * distinct - 1e-9)
        return dict(item_id=item, exact=exact, words=count, size=size, need=need,
                    text=words.text(begin, count), hashes=own.view(np.int64).tolist())

    schema = pa.schema([
        ("item_id", pa.int64()), ("exact", pa.bool_()), ("words", pa.int32()), ("size", pa.int32()),
        ("need", pa.int32()), ("text", pa.binary()), ("hashes", pa.list_(pa.int64()))])
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), binary_column(batch, "text")):
            words = find_words([text])
            hashes, n = word_hashes(words), len(words.starts)
            if not n:
                continue
            length = min(window, n)
            rows = [pattern(item, True, words, hashes, at, length) for at in range(n - length + 1)]
            if n > length:
                rows.append(pattern(item, False, words, hashes, 0, n))
            yield pa.RecordBatch.from_pylist(rows, schema)


def item_patterns(
    items: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
    id_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """The patterns of all items; equal windows of one item once."""
    narrow = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    made = narrow.mapInArrow(
        partial(_item_patterns, window=window, shingle=shingle, similarity=similarity), _PATTERN)
    return made.dropDuplicates(["item_id", "exact", "text"])


# --- counts of the patterns' shingles over all documents ---------------------------------------------------

class _Filter:
    """Membership in a sorted array of hashes, most misses told by a bitmap."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes`` that are members, and which members they are."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[hashes >> np.uint64(64 - _FILTER_BITS)])
        which = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[which] == hashes[at]
        return at[same], which[same]


def _within(words, size: int, at: np.ndarray) -> np.ndarray:
    """Whether the shingle of ``size`` words at each place ends in the text it starts in."""
    last = words.first[np.searchsorted(words.first, at, side="right")]
    return at + size <= last


def _document_counts(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    filters = known.value
    totals = {size: np.zeros(len(f.hashes), np.int64) for size, f in filters.items()}
    for batch in batches:
        texts = binary_column(batch, "text")
        for lo, hi in pieces(np.array([len(t) for t in texts])):
            words = find_words(texts[lo:hi])
            hashes = word_hashes(words)
            for size, each in filters.items():
                at, which = each.find(shingle_hashes(hashes, size))
                which = which[_within(words, size, at)]
                totals[size] += np.bincount(which, minlength=len(each.hashes))
    for size, each in filters.items():
        seen = np.flatnonzero(totals[size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(each.hashes[seen].view(np.int64)), pa.array(totals[size][seen])], ["hash", "n"])


def _prefixes(block: DataFrame, texts: DataFrame) -> DataFrame:
    """``(pattern, offset, hash)``: the rarest shingles of each pattern, as many as its need demands."""
    shingles = cut(block.select(
        "pattern", "size", "need", F.array_size(F.array_distinct("hashes")).alias("m"),
        F.posexplode("hashes").alias("offset", "hash")))
    distinct = shingles.select("size", "hash").distinct().toPandas()
    filters = {int(s): _Filter(np.sort(g.to_numpy(np.int64).view(np.uint64)))
               for s, g in distinct.groupby("size")["hash"]}
    known = block.sparkSession.sparkContext.broadcast(filters)
    counts = texts.mapInArrow(partial(_document_counts, known=known), "hash long, n long").groupBy(
        "hash").agg(F.sum("n").alias("n"))
    rarest = Window.partitionBy("pattern").orderBy(F.coalesce("n", F.lit(0)), "hash")
    # A repeated shingle has one rank and keeps all its offsets.
    ranked = shingles.join(counts, "hash", "left").withColumn("rank", F.dense_rank().over(rarest))
    length = F.when(F.col("need") >= F.col("m"), 1).otherwise(F.col("m") - F.col("need") + 1)
    return ranked.filter(F.col("rank") <= length).select("pattern", "offset", "hash", "size")


# --- the join ------------------------------------------------------------------------------------------

class _Index:
    """Prefix shingles of a block and the patterns they belong to."""

    def __init__(self, patterns: list[dict], prefixes):
        self.rows = {r["pattern"]: SimpleNamespace(**r) for r in patterns}
        self.sets = {p: frozenset(r.hashes) for p, r in self.rows.items() if not r.exact}
        self.filters, self.entries = {}, {}
        for size, part in prefixes.groupby("size"):
            part = part.sort_values("hash", key=lambda h: h.to_numpy(np.int64).view(np.uint64))
            every, starts = np.unique(part["hash"].to_numpy(np.int64).view(np.uint64), return_index=True)
            self.filters[int(size)] = _Filter(every)
            pairs = list(zip(part["pattern"].tolist(), part["offset"].tolist()))
            self.entries[int(size)] = [pairs[a:b] for a, b in zip(starts, np.append(starts[1:], len(pairs)))]


def _near(hashes: np.ndarray, first: int, last: int, at: int, row, own: frozenset) -> bool:
    """Whether a window of the item's length over place ``at`` holds enough of its shingles."""
    width = row.words - row.size + 1
    lo, hi = max(first, at - width + 1), min(last - row.size + 1, at + width)
    held = [h if h in own else None for h in hashes[lo:hi].view(np.int64).tolist()]
    for begin in range(max(1, len(held) - width + 1)):
        inside = set(held[begin:begin + width])
        inside.discard(None)
        if len(inside) >= row.need:
            return True
    return False


def _search(index: _Index, words, hashes: np.ndarray, n_texts: int) -> tuple[list, list]:
    spans, near = [[] for _ in range(n_texts)], [set() for _ in range(n_texts)]
    for size, each in index.filters.items():
        shingles = shingle_hashes(hashes, size)
        at, which = each.find(shingles)
        inside = _within(words, size, at)
        at, which = at[inside], which[inside]
        owner = np.searchsorted(words.first, at, side="right") - 1
        for place, w, text in zip(at.tolist(), which.tolist(), owner.tolist()):
            first, last = int(words.first[text]), int(words.first[text + 1])
            for pattern, offset in index.entries[size][w]:
                row, begin = index.rows[pattern], place - offset
                if row.exact:
                    if begin >= first and begin + row.words <= last and words.text(begin, row.words) == row.text:
                        spans[text].append((begin - first, row.words, row.item_id))
                elif row.item_id not in near[text] and last - first >= row.need + row.size - 1:
                    if _near(shingles, first, last, place, row, index.sets[pattern]):
                        near[text].add(row.item_id)
    return spans, near


def _join(batches: Iterator[pa.RecordBatch], index: Broadcast, keep_text: bool) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("item_id", pa.int64())])
    for batch in batches:
        texts = binary_column(batch, "text")
        counts, spans, near = [], [], []
        for lo, hi in pieces(np.array([len(t) for t in texts])):
            words = find_words(texts[lo:hi])
            found, close = _search(index.value, words, word_hashes(words), hi - lo)
            counts += np.diff(words.first).tolist()
            spans += [[dict(zip(("start", "words", "item_id"), s)) for s in set(f)] for f in found]
            near += [list(c) for c in close]
        spans = [old + new for old, new in zip(batch.column("spans").to_pylist(), spans)]
        near = [old + new for old, new in zip(batch.column("near").to_pylist(), near)]
        text = batch.column("text") if keep_text else pa.nulls(len(texts), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), text, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)),
             pa.array(near, pa.list_(pa.int64()))], ["id", "text", "n_words", "spans", "near"])


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, block_patterns: int = BLOCK_PATTERNS,
) -> DataFrame:
    """Per document ``(id, n_words, spans, near)``.

    ``spans`` has every place where an item window occurs: first word, number of words, item. ``near`` has
    the items of which a window as long as the item holds at least ``similarity`` of the shingles. NULL or
    empty texts have no words and meet nothing; items without words make no pattern. Rows that repeat an
    id are answered each; items that repeat an id or a text count each under their id. Empty tables give
    documents without spans, or no rows. Other columns are not read.
    """
    patterns = cut(item_patterns(items, window, shingle, similarity, item_id_col, item_text_col).select(
        F.xxhash64("item_id", "exact", "text").alias("pattern"), "*"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.select(
        "*", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,words:int,item_id:long>>").alias("spans"),
        F.array().cast("array<long>").alias("near"))
    blocks = max(1, -(-patterns.count() // block_patterns))
    for b in range(blocks):
        block = patterns.filter(F.pmod("pattern", F.lit(blocks)) == b)
        prefixes = _prefixes(block, texts).toPandas()
        index = docs.sparkSession.sparkContext.broadcast(_Index(block.toArrow().to_pylist(), prefixes))
        rows = rows.mapInArrow(partial(_join, index=index, keep_text=b < blocks - 1), _FOUND)
    return rows.select("id", "n_words", "spans", "near")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``contained_items`` as counts: ``(id, n_words, n_hit, items, near_items, contaminated)``.

    ``n_hit`` counts words inside any span; ``items`` and ``near_items`` are sorted lists of item ids,
    NULL ids left out. A document is contaminated if a window of an item occurs in it.
    """
    found = contained_items(docs, items, **options)
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["words"] - 1)))
    named = F.filter(F.transform("spans", lambda s: s["item_id"].cast("string")), lambda i: i.isNotNull())
    near = F.filter(F.transform("near", lambda i: i.cast("string")), lambda i: i.isNotNull())
    return found.select(
        "id", "n_words", F.array_size(F.array_distinct(hit)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(named)).alias("items"),
        F.array_sort(F.array_distinct(near)).alias("near_items")).withColumn(
        "contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold an item's window or nearly a whole item; all their columns.

    The decision is the text's, so it doesn't depend on ids: rows without an id go like others, and a clean row
    stays though a contaminated one repeats its id. Texts are told apart by a 64-bit hash. NULL and empty
    texts stay. An empty table stays empty, and without items everything stays.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(digest.alias("digest"), F.col(text_col).alias("text"))
    found = contamination(texts, items, id_col="digest", text_col="text", **options)
    bad = found.filter("contaminated OR size(near_items) > 0").select(F.col("id").alias("_gone")).distinct()
    gone = small(cut(bad))
    return docs.join(gone, digest == gone["_gone"], "left_anti")
