"""Divergence of sources: how far the word use of each source lies from its peers, and which words set it apart.

A group is a (language, source). For every term that its language keeps, a group has a smoothed share ``p`` in parts per
``SCALE``; two groups differ by the sum of ``(p - q)^2 / (p + q)`` over all terms, each summand rounded down.

Most terms are missing in most groups, where the share is a constant of the group, its baseline. With ``f`` the summand,
``a``, ``b`` the shares and ``a0``, ``b0`` the baselines of two groups, the sum over all terms is

    sum over terms of the first   f(a, b0)          from its histogram of shares
  + sum over terms of the second  f(a0, b)          the same with the groups exchanged
  + sum over common terms         f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
  + (terms - terms of the first - terms of the second) * f(a0, b0)

Only the third line needs both groups' terms. It is a row-by-row sparse product: Spark deals the term-major index out by
term, and in each slice every group walks through its terms' postings and adds to a dense accumulator with one place per
peer. No pair of postings is ever a row; a slice gives one number per pair of groups.

All numbers are integers, in 64 bits where they provably fit and in decimals where not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logsluice.llm.common import cut, small

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
# Counts held in a task before they go out; a document's own terms come on top.
HELD_TERMS = 500_000
# Postings of the index held in a task, places of its accumulators, and places of one step's gather.
HELD_POSTINGS = 500_000
HELD_PLACES = 4_000_000
GATHER = 1 << 20
# Peers per row of the peer table.
PEERS = 1024

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PAIR = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
COUNTS = "lang string, source string, term string, n long, docs long"
PAIR = "lang string, source string, item string, value long"


# --- terms -----------------------------------------------------------------------------------------------

def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters a-z and of everything beyond ASCII, A-Z lower-cased (``bytes.lower`` changes no others)."""
    return _TERM.findall(text.lower())


def _count(batches: Iterator[pa.RecordBatch], held_terms: int) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in counts.items():
            names = list(uses)
            for at in range(0, len(names), 50_000):
                part = names[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part)), pa.array([source] * len(part)),
                    pa.array(part, pa.binary()).cast(pa.string()), pa.array([uses[t] for t in part], pa.int64()),
                    pa.array([docs[t] for t in part], pa.int64())], schema=_COUNTS)
        counts.clear()

    held = 0
    for batch in batches:
        groups = zip(*(batch.column(c).to_pylist() for c in ("lang", "source")))
        for group, text in zip(groups, batch.column("text")):
            words = terms_of(text.as_buffer().to_pybytes())
            if not words:
                continue
            uses, docs = counts.setdefault(group, (Counter(), Counter()))
            before = len(uses)
            uses.update(words)
            docs.update(set(words))
            held += len(uses) - before
            if held > held_terms:
                yield from flush()
                held = 0
    yield from flush()


def _filled(docs: DataFrame, **columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in columns.items()])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)`` added up per task, several rows of a term if it comes from several tasks."""
    narrow = _filled(docs, lang=lang_col, source=source_col, text=text_col)
    return narrow.mapInArrow(partial(_count, held_terms=HELD_TERMS), COUNTS)


# --- shares ----------------------------------------------------------------------------------------------

def _share(count, total, terms):
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``; the product can pass 64 bits."""
    top = (count + F.lit(2)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + 2 * terms).cast("decimal(19,0)")
    return F.call_function("div", top, below) + F.lit(1)


F_SQL = "CAST((({0} - {1}) * ({0} - {1})) div ({0} + {1}) AS LONG)"


def shares(groups: DataFrame, counts: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """From all groups ``(lang, source)`` and the counts: groups ``(lang, source, peers, v, terms, total, p0)`` and kept terms ``(lang, source, term, p, p0, q)``.

    ``peers`` is the number of groups of the language, ``v`` that of its kept terms, ``terms`` those of the group, ``q`` the
    language's share. One shuffle by (language, term) serves the sums of groups, of languages and the choice of terms.
    """
    by_term = counts.repartition("lang", "term")
    uses = by_term.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = uses.withColumns(
        {"all_docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term),
         "first": F.row_number().over(term.orderBy("source")) == 1})
    kept = cut(kept.filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "all_n", "first"))
    langs = kept.groupBy("lang").agg(
        F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.count("*").alias("terms"), F.sum("n").alias("total"))
    peers = groups.groupBy("lang").agg(F.count("*").alias("peers"))
    groups = groups.join(peers, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["v", "lang_total", "terms", "total"])
    p0 = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)
    groups = cut(groups.withColumn("p0", p0.cast("long")))
    every = kept.join(small(groups), ["lang", "source"])
    every = every.select(
        "lang", "source", "term", "p0", _share(F.col("n"), F.col("total"), F.col("v")).cast("long").alias("p"),
        _share(F.col("all_n"), F.col("lang_total"), F.col("v")).cast("long").alias("q"))
    return groups, every


# --- common terms: the sparse product ---------------------------------------------------------------------

def summand(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / (p + q))``; shares are at most SCALE + 1, so the square fits."""
    return (p - q) * (p - q) // np.maximum(p + q, 1)


class Accumulators:
    """Dense rows of one language: for each group a number per peer."""

    def __init__(self, lang: str):
        self.lang, self.place, self.names = lang, {}, []
        self.rows: list[np.ndarray] = []

    def places(self, names: list[str]) -> np.ndarray:
        for name in names:
            if name not in self.place:
                self.place[name] = len(self.names)
                self.names.append(name)
                self.rows.append(np.zeros(0, np.int64))
        return np.array([self.place[n] for n in names], np.int64)

    def add(self, term: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray, gather: int = GATHER) -> None:
        """Add a slice of whole terms, its postings sorted by term; each group scatters its terms."""
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        sizes = np.diff(np.append(starts, len(term)))
        of_term = np.repeat(np.arange(len(starts)), sizes)
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0, [True]]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = order[lo:hi]
            row = self.row(group[own[0]])
            width = np.cumsum(sizes[of_term[own]])
            at = 0
            while at < len(own):
                done = width[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(width, done + gather, "right")))
                mine = own[at:end]
                length = sizes[of_term[mine]]
                first = np.cumsum(length) - length
                there = np.arange(int(length.sum())) - np.repeat(first, length) + np.repeat(starts[of_term[mine]], length)
                a, a0 = np.repeat(p[mine], length), np.repeat(p0[mine], length)
                b, b0 = p[there], p0[there]
                np.add.at(row, group[there], summand(a, b) - summand(a, b0) - summand(a0, b) + summand(a0, b0))
                at = end

    def row(self, group: int) -> np.ndarray:
        if len(self.rows[group]) < len(self.names):
            grown = np.zeros(len(self.names), np.int64)
            grown[:len(self.rows[group])] = self.rows[group]
            self.rows[group] = grown
        return self.rows[group]

    def size(self) -> int:
        return sum(map(len, self.rows))

    def take(self) -> Iterator[pa.RecordBatch]:
        """The numbers as rows, and zeros from here on."""
        for group, row in enumerate(self.rows):
            peers = np.flatnonzero(row)
            peers = peers[peers != group]
            if len(peers):
                yield pa.RecordBatch.from_arrays([
                    pa.array([self.lang] * len(peers)), pa.array([self.names[group]] * len(peers)),
                    pa.array([self.names[i] for i in peers]), pa.array(row[peers])], schema=_PAIR)
            self.rows[group] = np.zeros(0, np.int64)


def _product(batches: Iterator[pa.RecordBatch], held_postings: int, held_places: int) -> Iterator[pa.RecordBatch]:
    """Postings come sorted by language and term; whole terms of one language make a slice."""
    rows: Accumulators | None = None
    held: list[pa.RecordBatch] = []

    def add(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal rows
        langs = table.column("lang").to_pylist()
        at = 0
        while at < len(langs):
            end = at
            while end < len(langs) and langs[end] == langs[at]:
                end += 1
            part = table.slice(at, end - at)
            if rows is None or rows.lang != langs[at]:
                if rows is not None:
                    yield from rows.take()
                rows = Accumulators(langs[at])
            names = part.column("source").combine_chunks().dictionary_encode()
            group = rows.places(names.dictionary.to_pylist())[names.indices.to_numpy()]
            term = part.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            rows.add(term, group, part.column("p").to_numpy(), part.column("p0").to_numpy())
            if rows.size() > held_places:
                yield from rows.take()
            at = end

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= held_postings:
            table = pa.Table.from_batches(held)
            keys = list(zip(*(table.column(c).slice(max(0, table.num_rows - 1)).to_pylist() for c in ("lang", "term"))))
            langs, terms = table.column("lang"), table.column("term")
            end = table.num_rows
            while end and (langs[end - 1].as_py(), terms[end - 1].as_py()) == keys[0]:
                end -= 1
            if end:
                yield from add(table.slice(0, end))
                held = table.slice(end).to_batches()
    if held:
        yield from add(pa.Table.from_batches(held))
    if rows is not None:
        yield from rows.take()


def common_terms(every: DataFrame, held_postings: int = HELD_POSTINGS, held_places: int = HELD_PLACES) -> DataFrame:
    """``(lang, source, item, value)``: sums over common terms, several rows of a pair from several slices.

    A slice is bounded by ``held_postings`` and the postings of one term, of which there is one per group.
    """
    index = every.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions(
        "lang", "term")
    return index.mapInArrow(partial(_product, held_postings=held_postings, held_places=held_places), PAIR)


# --- terms of one group against all baselines ----------------------------------------------------------------

def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            p, m = (np.array(r[c] or [], np.int64) for c in ("ps", "ms"))
            peers, b0, there = r["peers"], np.array(r["p0s"], np.int64), np.array(r["sizes"], np.int64)
            own = np.zeros(len(peers), np.int64)
            for at in range(0, len(p), 1 << 10):
                step = summand(p[at:at + (1 << 10), None], b0[None, :])
                own += (step * m[at:at + (1 << 10), None]).sum(axis=0)
            # Half of the terms that neither has goes to each of the two directions: the first by name takes it whole.
            rest = (r["v"] - r["terms"] - there) * summand(np.full(len(peers), r["p0"], np.int64), b0)
            whole = own + np.array([q > r["source"] for q in peers]) * rest
            lang, mine = [r["lang"]] * len(peers), [r["source"]] * len(peers)
            keep = pa.array([q != r["source"] for q in peers])
            for a, b in ((mine, peers), (peers, mine)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang), pa.array(a), pa.array(b), pa.array(whole)], schema=_PAIR).filter(keep)


def against_baselines(groups: DataFrame, every: DataFrame, peers: int = PEERS) -> DataFrame:
    """``(lang, source, item, value)`` for all ordered pairs of groups of a language, two rows each.

    A group's histogram is one cell; it has as many places as there are different counts in it, at most the
    square root of twice its words. It meets its peers in rows of about ``peers`` of them.
    """
    steps = every.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    steps = steps.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("steps"))
    steps = steps.select("lang", "source", F.col("steps.p").alias("ps"), F.col("steps.m").alias("ms"))
    row = F.pmod(F.xxhash64("source"), F.ceil(F.col("peers") / peers))
    rows = groups.select("lang", "source", "p0", "terms", row.alias("row"))
    rows = rows.groupBy("lang", "row").agg(F.collect_list(F.struct("source", "p0", "terms")).alias("peer"))
    rows = rows.select(
        "lang", F.col("peer.source").alias("peers"), F.col("peer.p0").alias("p0s"), F.col("peer.terms").alias("sizes"))
    sides = groups.select("lang", "source", "v", "terms", "p0").join(steps, ["lang", "source"], "left").join(rows, "lang")
    return sides.mapInArrow(_baselines, PAIR)


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of sources, and the words that set a source apart.

    ``part`` is ``pair``, where ``item`` is another source of the language and ``value`` their distance, or ``term``,
    where ``item`` is a term that the group uses more than its language, up to ``top_terms`` of them. Ranks go by value,
    larger first, then by the bytes of the item. A term counts if at least ``min_docs`` documents of its language hold it.

    NULL language, source and text are empty, and the empty language or source is a group like any other. Texts
    without words make their group and add nothing. Repeated rows count each. Very long texts are counted whole. A
    language with one source has no pairs, one without kept terms pairs of value 0. An empty table gives no rows.
    Other columns are not read, so their names don't matter.
    """
    groups = _filled(docs, lang=lang_col, source=source_col).distinct()
    groups, every = shares(groups, term_counts(docs, lang_col, source_col, text_col), min_docs)
    every = cut(every)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = against_baselines(groups, every).unionByName(common_terms(every))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = every.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr(F_SQL.format("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(columns))
