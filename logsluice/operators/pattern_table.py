"""Detectors that are a table: thousands of a user's patterns against documents.

Each pattern is reduced to literals of which every match holds at least one. An automaton over the literals of a
block of patterns reads a text once and tells which patterns can match it; only these are run, by the same expression
that runs a single detector. Patterns without such literals run on every text. Blocks are bounded in number and
size of their patterns, one is handed to the tasks at a time, and nothing is joined or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from logsluice.functions import spans as S
from logsluice.functions.regexlang import split_named_groups
from logsluice.session import cut

# Patterns and characters of a block.
BLOCK_PATTERNS = 20_000
BLOCK_CHARS = 4_000_000
# Shorter literals are in nearly every text.
MIN_LITERAL = 3
# Ways a pattern may branch; with more, the branches count as anything.
MAX_LITERALS = 64

CUSTOM_SCORE = 0.9
_LIST = ArrayType(StructType([
    StructField("ord", IntegerType()), StructField("type", StringType()), StructField("pattern", StringType()),
    StructField("score", DoubleType())]))


# --- literals of a pattern --------------------------------------------------------------------------------

def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match of the pattern holds one; None if there is no such set.

    Only ASCII counts, as the case of other letters is a matter of flags. Syntax that Python doesn't parse, of which
    Java has some, gives None, so such a pattern is run on every text.
    """
    try:
        tree = re._parser.parse(split_named_groups(pattern)[0])
    except (re.error, OverflowError, RecursionError, ValueError):
        return None
    if tree.state.flags & re.VERBOSE:
        return None
    found = _best(_sets(tree))
    return sorted(found) if found else None


def _sets(tree) -> list[frozenset[str]]:
    """Sets of literals; a match holds one of each set."""
    out: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if len(run) >= MIN_LITERAL:
            out.append(frozenset([run]))
        run = ""

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if name == "SUBPATTERN" and len(arg[3]) and all(str(o) == "LITERAL" and a < 128 for o, a in arg[3]):
            run += "".join(chr(a).lower() for _, a in arg[3])
            continue
        if name in ("AT", "ASSERT_NOT", "ASSERT"):
            # Takes no characters: what stands on both sides is still one run.
            continue
        end()
        if name in ("SUBPATTERN", "ATOMIC_GROUP"):
            out += _sets(arg[3] if name == "SUBPATTERN" else arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            out += _sets(arg[2])
        elif name == "BRANCH":
            branches = [_best(_sets(b)) for b in arg[1]]
            if all(branches) and sum(map(len, branches)) <= MAX_LITERALS:
                out.append(frozenset().union(*branches))
    end()
    return out


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest literal is longest; of equals the smallest set."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=None)


# --- one block -------------------------------------------------------------------------------------------

def _candidates(batches: Iterator[pa.RecordBatch], text: str, block) -> Iterator[pa.RecordBatch]:
    import ahocorasick  # here, as only tasks need it

    always, keyed = block.value
    automaton = ahocorasick.Automaton()
    owners: dict[str, list[tuple]] = {}
    for literals, pattern in keyed:
        for literal in literals:
            owners.setdefault(literal, []).append(pattern)
    for literal, patterns in owners.items():
        automaton.add_word(literal, patterns)
    if owners:
        automaton.make_automaton()
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("type", pa.string()), ("pattern", pa.string()), ("score", pa.float64())]))
    for batch in batches:
        found = []
        for value in batch.column(text).to_pylist():
            hits = {}
            if value is not None and owners:
                for _, patterns in automaton.iter(value.lower()):
                    if patterns[0][0] not in hits or len(patterns) > 1:
                        hits.update((p[0], p) for p in patterns)
            chosen = sorted([*always, *hits.values()]) if value is not None else []
            found.append([dict(ord=o, type=t, pattern=p, score=s) for o, t, p, s in chosen])
        keep = pa.array([bool(f) for f in found])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "candidates"]).filter(keep)


def _blocks(patterns: DataFrame, name: str, regex: str, score: float) -> Iterator[tuple[list, list]]:
    """The usable patterns in the order of their names and texts, a bounded block at a time."""
    ordered = patterns.select(F.upper(F.coalesce(name, F.lit("CUSTOM_PATTERN"))).alias("type"), F.col(regex).alias("pattern"))
    ordered = ordered.filter(F.trim("pattern") != "").distinct().orderBy("type", "pattern")
    block, chars = [], 0
    for place, r in enumerate(ordered.toLocalIterator()):
        if block and (len(block) == BLOCK_PATTERNS or chars + len(r["pattern"]) > BLOCK_CHARS):
            yield _split(block)
            block, chars = [], 0
        block.append((place, r["type"], f"(?i){split_named_groups(r['pattern'])[0]}", score))
        chars += len(r["pattern"])
    if block:
        yield _split(block)


def _split(block: list[tuple]) -> tuple[list, list]:
    keyed = [(required_literals(p[2]), p) for p in block]
    return [p for literals, p in keyed if not literals], [(x, p) for x, p in keyed if x]


def find_spans(
    df: DataFrame, keys: Sequence[str], text: str, patterns: DataFrame, name: str = "name", regex: str = "regex",
    score: float = CUSTOM_SCORE,
) -> DataFrame:
    """``(keys, start, end, ord, type, text, score)``: spans of all patterns in all texts, as the detectors made of
    them one by one find them: any case, offsets in code points, spans of three characters or more.

    ``patterns`` has a name and a pattern per row. Blank and NULL patterns are left out, equal rows count once; a name may
    have several patterns. ``ord`` is the place of the pattern by name and text. A pattern that Java rejects fails the job.
    NULL texts have no spans. Without patterns there are none.
    """
    spark = df.sparkSession
    narrow = df.select(*keys, F.col(text).cast("string").alias("_text"))
    parts = []
    schema = StructType([*narrow.schema.fields]).add("candidates", _LIST)
    blocks = _blocks(patterns, name, regex, score)
    block = next(blocks, None)
    while block is not None:
        held, block = spark.sparkContext.broadcast(block), next(blocks, None)
        rows = narrow.mapInArrow(partial(_candidates, text="_text", block=held), schema)
        rows = rows.select(*keys, "_text", F.explode_outer("candidates").alias("_c")).filter("_c IS NOT NULL")
        rows = rows.select(*keys, "_text", *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("ord", "type", "pattern", "score")])
        found = rows.select(*keys, F.explode_outer(S.detect_by("_text", "_pattern", "_ord", "_type", "_score")).alias("_s"))
        found = found.filter("_s IS NOT NULL").select(*keys, "_s.*")
        # Several blocks: each one's spans are written, and the block is given up before the next.
        if parts or block is not None:
            found = cut(found)
            held.destroy()
        parts.append(found)
    if parts:
        return reduce(DataFrame.unionByName, parts)
    empty = narrow.select(*keys, F.explode(F.expr(f"CAST(array() AS {S.SPANS_TYPE})")).alias("_s"))
    return empty.select(*keys, "_s.*")
