"""Near duplicates by SimHash: fingerprints, and a self-join of them over binary tries.

Fingerprints within a few differing bits are found by walking a binary trie against itself: pairs of
nodes go down together, each pair carries the bits that differ so far, and a pair over the budget is
left with everything below it.

One trie over all fingerprints would not fit a task, so Spark deals out subtrees. Of ``budget + 1``
bands of the 64 bits, two fingerprints within the budget share one at least; each band's value is a
group. A group of more than ``group_rows`` fingerprints is split the same way over the bits that its
members may still differ in, as often as needed: members are distinct, so fewer free bits mean fewer
members, and no link is lost. Each group reports a spanning forest of its links, never all pairs, and
connected components are joined in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logsluice.llm.common import binary_column, cut, small

SEED = 42
BITS = 64
SHINGLE_WORDS = 3
BUDGET = 2
GROUP_ROWS = 1024


# --- fingerprints -------------------------------------------------------------------------------

def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of lower-cased UTF-8 text over shingles of words; 0 without words.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` parts at space and the codes 9 to 13.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t, words) for t in binary_column(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` holds the 64 bits as a long. NULL text has no words."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(partial(_fingerprints, words=words), "id long, fp long")


# --- the trie join of one task --------------------------------------------------------------------

def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked fingerprints, each group's ``[start, end)`` sorted and distinct.

    A node is a range of the sorted array. All groups go down bit by bit together.
    """
    keep = ends - starts > 1
    a_lo, a_hi = starts[keep], ends[keep]
    b_lo, b_hi = a_lo, a_hi
    diff = np.zeros(len(a_lo), np.int8)
    for bit in range(BITS - 1, -1, -1):
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        other = (a_lo != b_lo) | (a_hi != b_hi)
        children = [
            (a_lo, a_mid, b_lo, b_mid, diff), (a_mid, a_hi, b_mid, b_hi, diff),
            (a_lo, a_mid, b_mid, b_hi, diff + 1),
            (a_mid[other], a_hi[other], b_lo[other], b_mid[other], diff[other] + 1)]
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(c) for c in zip(*children))
        itself = (a_lo == b_lo) & (a_hi - a_lo == 1)
        keep = (a_hi > a_lo) & (b_hi > b_lo) & (diff <= budget) & ~itself
        a_lo, a_hi, b_lo, b_hi, diff = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], diff[keep]
    return a_lo, b_lo


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each index the smallest index that links reach."""
    label = np.arange(size)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _group_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Star edges ``(a, b)`` of the groups, which come whole and one after the other."""
    mask = fp = np.zeros(0, np.uint64)

    def links(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        value = fp & mask
        order = np.lexsort((fp, value, mask))
        mask, value, fp = mask[order], value[order], fp[order]
        new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
        a, b = trie_pairs(fp, new, np.append(new[1:], len(fp)), budget)
        root = forest(len(fp), a, b)
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays(
            [pa.array(fp[child].view(np.int64)), pa.array(fp[root[child]].view(np.int64))], ["a", "b"])

    for batch in batches:
        mask = np.concatenate([mask, batch.column("mask").to_numpy().view(np.uint64)])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(fp):
            continue
        value = fp & mask
        whole = (mask != mask[-1]) | (value != value[-1])
        done = int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0
        if done:
            yield links(mask[:done], fp[:done])
            mask, fp = mask[done:], fp[done:]
    if len(fp):
        yield links(mask, fp)


# --- groups in Spark ------------------------------------------------------------------------------

def _bands(mask: int, count: int) -> list[int]:
    """``mask`` widened by each of ``count`` runs of the bits that are still free."""
    free = [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / count) for i in range(count + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _levels(budget: int, group_rows: int) -> list[list[tuple[int, list[int]]]]:
    """Masks of each level with those they split into, until no group can be too large."""
    level, levels = [0], []
    while any(1 << (BITS - bin(m).count("1")) > group_rows for m in level):
        split = [(m, _bands(m, budget + 1)) for m in level]
        levels.append(split)
        level = sorted({w for _, wider in split for w in wider})
        if len(levels) > 8:
            break
    return levels


def _groups(distinct: DataFrame, budget: int, group_rows: int) -> DataFrame:
    """``(mask, fp)``: every fingerprint under each group it belongs to."""
    levels = _levels(budget, group_rows)
    value = F.col("fp").bitwiseAND(F.col("mask")).alias("value")
    frame = distinct.select("fp", F.explode(F.array(*[
        F.lit(_signed(m)).cast("long") for m in levels[0][0][1]])).alias("mask"))
    done = None
    for level in levels[1:]:
        frame = frame.select("mask", "fp", value)
        sizes = frame.groupBy("mask", "value").count()
        large = cut(sizes.filter(F.col("count") > group_rows).select("mask", "value"))
        if large.isEmpty():
            break
        rest = frame.join(large, ["mask", "value"], "left_anti").select("mask", "fp")
        done = rest if done is None else done.unionByName(rest)
        wider = F.create_map(*[x for mask, masks in level for x in (
            F.lit(_signed(mask)).cast("long"), F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))])
        frame = cut(frame.join(large, ["mask", "value"], "left_semi").select(
            F.explode(wider[F.col("mask")]).alias("mask"), "fp").distinct())  # two masks may widen to the same one
    frame = frame.select("mask", "fp")
    return frame if done is None else done.unionByName(frame)


def trie_links(distinct: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``(a, b)`` that span the same components as all pairs within ``budget`` bits."""
    grouped = _groups(distinct, budget, group_rows).select(
        "mask", "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    parts = grouped.repartition("mask", "value").sortWithinPartitions("mask", "value").select("mask", "fp")
    return parts.mapInArrow(partial(_group_links, budget=budget), "a long, b long")


# --- components -------------------------------------------------------------------------------------

def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step towards stars: every neighbour links to the smallest one.

    The large step moves the neighbours above a node, the small step those below it.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.filter("b < a")
    lowest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    moved = (both.filter("b > a") if large else around).join(lowest, "a")
    out = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        out = out.unionByName(lowest.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """``(fp, root)`` of every linked fingerprint but the roots; alternating star steps in Spark."""
    edges = cut(links.filter("a <> b").distinct())
    seen = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("root"))
        seen = state
        edges = cut(_star(_star(edges, True), False))


def _classes(
    docs: DataFrame, id_col: str, text_col: str, words: int, budget: int, group_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` per document and ``(fp, root, component_id)`` per fingerprint; ``root`` names its component."""
    fps = cut(fingerprints(docs, id_col, text_col, words))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = component_roots(trie_links(classes.select("fp"), budget, group_rows))
    joined = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps, joined.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
    budget: int = BUDGET, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per document: ``(id, fp, component_id)``, the id as long.

    ``component_id`` is the smallest id that links of at most ``budget`` differing bits reach. NULL or
    empty text has fingerprint 0 and links like any other. A repeated id keeps each of its rows. A
    row with a NULL id counts for linking; a component without any other id has a NULL component.
    An empty table gives no rows. Other columns are not read, so their names don't matter.
    """
    fps, classes = _classes(docs, id_col, text_col, words, budget, group_rows)
    return fps.join(classes.drop("root"), "fp").select("id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _with_fingerprint(batches: Iterator[pa.RecordBatch], text_col: str, words: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t, words) for t in binary_column(batch, text_col)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], [*batch.schema.names, name])


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
    budget: int = BUDGET, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One document of each component stays, that with the smallest id, NULL last; all columns of ``docs``.

    Rows with an id of their own find their decision by it. Rows that share an id or have none get their fingerprint
    again and are judged by both; of rows that repeat both one stays. NULL, empty and blank texts are one
    component. Very long texts are fingerprinted whole. An empty table gives no rows. Column names may clash with none,
    as those used here are chosen apart from them.
    """
    fps, classes = _classes(docs, id_col, text_col, words, budget, group_rows)
    found = cut(fps.join(classes, "fp").select("id", "fp", "root"))
    keeper = cut(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("k")))
    shared = small(cut(found.groupBy("id").count().filter("count > 1 OR id IS NULL").select("id")))
    goes = found.join(keeper.select("root", F.col("k.id").alias("kept")), "root").filter("NOT id <=> kept")
    goes = small(cut(goes.filter("id IS NOT NULL").select("id").distinct()))
    key = docs[id_col].cast("long")
    once = docs.join(shared, key.eqNullSafe(shared["id"]), "left_anti").join(goes, key == goes["id"], "left_anti")
    if shared.isEmpty():
        return once
    name = "fp"
    while name in docs.columns:
        name = f"_{name}"
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    again = docs.join(shared, key.eqNullSafe(shared["id"]), "left_semi").mapInArrow(
        partial(_with_fingerprint, text_col=text_col, words=words, name=name), schema)
    stays = keeper.select(F.col("k.id").alias("id"), F.col("k.fp").alias("fp")).join(
        shared.withColumnRenamed("id", "shared_id"), F.col("id").eqNullSafe(F.col("shared_id")), "left_semi")
    stays = small(cut(stays))
    again = again.join(
        stays, again[id_col].cast("long").eqNullSafe(stays["id"]) & (again[name] == stays["fp"]), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col, name]).drop(name))
