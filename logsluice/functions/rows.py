"""Array columns: to rows, running totals, first occurrences, pieces of a long text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def each(
    df: DataFrame, keys: Sequence[str | Column], array: str | Column, name: str = "s",
    pos: str | None = None,
) -> DataFrame:
    """One row per element, with its position if ``pos`` names one; NULL elements drop.

    ``explode`` would let the optimizer infer a filter on the size of the array and push it below,
    where the array's whole expression is evaluated a second time with its inputs written out. The
    outer form infers nothing, and dropping the NULL rows it adds costs nothing.
    """
    if pos is None:
        rows = df.select(*keys, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keys, F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())


# --- Work inside one row, in O(n log n) at most, however long its arrays are ------------------------------------

BLOCK_CHARS = 256


RUN = 32


def running_sql(values: str, combine: str = "x + y") -> str:
    """SQL for running totals of an array, each with its own value.

    ``combine`` joins ``x`` with the total ``y`` in front of it. Totals are formed within runs of ``RUN`` elements, where
    growing an array copies little; totals of the runs are then joined in doubling steps and carried into the next runs.
    """
    total = f"transform(array(acc[size(acc) - 1]), y -> {combine})[0]"
    run = (
        f"aggregate(slice(v, at + 1, {RUN}), slice(v, 1, 0), (acc, x) -> "
        f"concat(acc, array(CASE WHEN size(acc) = 0 THEN x ELSE {total} END)))")
    steps = "sequence(0, CAST(ceil(log2(size(runs))) AS INT) - 1)"
    carry = f"""aggregate({steps}, transform(runs, r -> r[size(r) - 1]), (acc, k) -> transform(acc, (x, i) ->
        CASE WHEN i >= shiftleft(1, k) THEN transform(array(acc[i - shiftleft(1, k)]), y -> {combine})[0] ELSE x END))"""
    carried = f"""transform(array({carry}), sums -> flatten(transform(runs, (r, j) ->
        CASE WHEN j = 0 THEN r ELSE transform(array(sums[j - 1]), y -> transform(r, x -> {combine}))[0] END)))[0]"""
    return f"""transform(array({values}), v -> CASE WHEN size(v) <= 1 THEN v
        ELSE transform(array(transform(sequence(0, size(v) - 1, {RUN}), at -> {run})), runs ->
          CASE WHEN size(runs) = 1 THEN runs[0] ELSE {carried} END)[0] END)[0]"""


def running(values: Column, combine: Callable[[Column, Column], Column] | None = None) -> Column:
    """Running totals of an array as a column, like :func:`running_sql`; sums by default."""
    combine = combine or (lambda x, y: x + y)

    def totals(v: Column) -> Column:
        def run(at: Column) -> Column:
            return F.aggregate(F.slice(v, at + 1, F.lit(RUN)), F.slice(v, F.lit(1), F.lit(0)), lambda acc, x: F.concat(
                acc, F.array(F.when(F.size(acc) == 0, x).otherwise(combine(x, F.element_at(acc, -1))))))

        runs = bind(F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(RUN)), run), joined)
        return F.when(F.size(v) <= 1, v).otherwise(runs)

    def joined(runs: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            width = F.pow(F.lit(2), k).cast("int")
            return bind(width, lambda w: F.transform(acc, lambda x, i: F.when(
                i >= w, combine(x, F.get(acc, i - w))).otherwise(x)))

        def carried(sums: Column) -> Column:
            return F.flatten(F.transform(runs, lambda r, j: F.when(j == 0, r).otherwise(
                bind(F.get(sums, j - 1), lambda y: F.transform(r, lambda x: combine(x, y))))))

        last = F.ceil(F.log2(F.size(runs))).cast("int") - 1
        ends = F.transform(runs, lambda r: F.element_at(r, -1))
        return F.when(F.size(runs) == 1, F.get(runs, 0)).otherwise(
            bind(F.aggregate(F.sequence(F.lit(0), last), ends, step), carried))

    return bind(values, totals)


def first_flags(names: Column) -> Column:
    """For each element whether it is the first of its value, as ``array<struct(place, first)>`` by place."""
    places = F.sort_array(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("place"))))
    flags = bind(places, lambda every: F.transform(every, lambda e, j: F.struct(
        e["place"].alias("place"),
        ((j == 0) | ~e["name"].eqNullSafe(F.get(every, j - 1)["name"])).alias("first"))))
    return F.sort_array(flags)


def text_blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK_CHARS`` characters, so that cutting a piece need not start at its front."""
    return F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{BLOCK_CHARS}}}"), F.lit(0))


def cut_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of a text in blocks."""
    def piece(first: Column) -> Column:
        count = F.floor((end - 1) / BLOCK_CHARS).cast("int") - first + 1
        return F.substring(F.array_join(F.slice(blocks, first + 1, count), ""), start - first * BLOCK_CHARS + 1, end - start)

    return F.when(end > start, bind(F.floor(start / BLOCK_CHARS).cast("int"), piece)).otherwise("")
