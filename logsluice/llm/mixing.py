"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture. Its mean repetition rate is what brings its characters to
that share; every document draws its number of copies from a Poisson distribution with that mean, by
inverting the distribution at a uniform number hashed from a seed and its id. A rate above ``DRAW_RATE`` is
the sum of several independent draws of equal, smaller rates. Copies are then dealt out
globally in the order of another hash.

Everything is DataFrame expressions. The weights are the caller's, so the table of sources has one row per
named source and one for all others, and may be broadcast whatever the data's size; a source that holds a
third of all rows is one row there and is never gathered. Moving each copy once, in the last step, is the
shuffle that was asked for.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from logsluice.llm.common import cut

SEED = "mix-1"
_UNIFORM_BITS = 52
# A Poisson variable above its mean by this many terms has a probability below the uniform's last bit.
_TAIL_TERMS = 60
# The largest mean of one draw.
DRAW_RATE = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts, the same in every engine that has MD5."""
    digest = F.md5(F.concat_ws("/", *parts))
    return F.conv(F.substring(digest, 1, _UNIFORM_BITS // 4), 16, 10).cast("long") / F.lit(float(1 << _UNIFORM_BITS))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), …: the number of steps at or below a uniform number is Poisson.

    As many terms as the uniform's 52 bits can tell apart.
    """
    terms = F.sequence(F.lit(1), (2 * F.ceil(rate)).cast("int") + _TAIL_TERMS)
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("steps"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["steps"], F.element_at(acc["steps"], -1) + p).alias("steps"))

    return F.aggregate(terms, start, add, lambda acc: acc["steps"])


def source_rates(
    docs: DataFrame, weights: Mapping[str, float], rest: float, size: float = 1.0, source_col: str = "source",
    text_col: str = "text", max_rate: float | None = None,
) -> DataFrame:
    """``(bucket, chars, rate)``: one row per named source and one, with a NULL bucket, for the others.

    The rate is target share × mixture size ÷ characters, the mixture being ``size`` times the characters
    of all documents.
    """
    if any(w < 0 for w in [*weights.values(), rest]) or rest + sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scale = sum(weights.values()) + rest
    share = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(w / scale))]) if weights else None
    totals = docs.groupBy(_bucket(weights, source_col).alias("bucket")).agg(
        F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("chars"))
    totals = cut(totals)
    everything = totals.agg(F.sum("chars")).first()[0] or 0
    target = F.lit(rest / scale)
    if share is not None:
        target = F.when(F.col("bucket").isNull(), rest / scale).otherwise(share[F.col("bucket")])
    rate = target * size * F.lit(float(everything)) / F.col("chars")
    if max_rate is not None:
        rate = F.least(rate, F.lit(max_rate))
    rate = F.when(F.col("chars") > 0, rate).otherwise(0.0)
    return totals.withColumn("rate", rate)


def _bucket(weights: Mapping[str, float], source_col: str) -> Column:
    source = F.col(source_col).cast("string")
    return F.when(source.isin(*weights), source) if weights else F.lit(None).cast("string")


def mix(
    docs: DataFrame, weights: Mapping[str, float], rest: float, size: float = 1.0, seed: str = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_rate: float | None = None,
) -> DataFrame:
    """The mixture: all columns of ``docs``, and ``mix_rate``, ``mix_copy`` (from 0) and ``mix_order``.

    Rows are in global order of ``mix_order``, a hash of seed, id and copy. Sources that are not named,
    NULL among them, share ``rest``. A source without characters has rate 0, so its documents leave; so
    do those of a source with weight 0. With ``max_rate`` no source is repeated more
    often than that on average, and then misses its share. Rows that repeat an id get the
    same number of copies each; rows without an id are told apart by their texts. An empty table gives an empty mixture. Columns named like those added
    are replaced.
    """
    rates = F.broadcast(source_rates(docs, weights, rest, size, source_col, text_col, max_rate).withColumn(
        "draws", F.greatest(F.ceil(F.col("rate") / DRAW_RATE), F.lit(1)).cast("int")).withColumn(
        "steps", poisson_steps(F.col("rate") / F.col("draws"))))
    kept = [c for c in docs.columns if c not in ("mix_rate", "mix_copy", "mix_order")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), _bucket(weights, source_col).alias("doc_bucket"),
        F.coalesce(F.col(id_col).cast("string"), F.concat(
            F.lit("text "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).alias("key"),
        F.monotonically_increasing_id().alias("place"))
    rows = rows.join(rates, F.col("doc_bucket").eqNullSafe(F.col("bucket"))).withColumn(
        "u", uniform(F.lit(seed), F.col("key"), F.lit("count")))

    def draw(u: Column) -> Column:
        return F.size(F.filter("steps", lambda step: step <= u))

    more = F.aggregate(F.sequence(F.lit(1), F.col("draws") - 1), draw(F.col("u")), lambda total, i: total + draw(
        uniform(F.lit(seed), F.col("key"), F.lit("count"), i.cast("string"))))
    drawn = rows.withColumn("copies", F.when(F.col("draws") > 1, more).otherwise(draw(F.col("u")))).filter("copies > 0")
    out = drawn.select("doc", "key", "place", "rate", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    out = out.select(
        "doc", "place", F.col("rate").alias("mix_rate"), F.col("copy").alias("mix_copy"),
        F.md5(F.concat_ws("/", F.lit(seed), "key", F.col("copy").cast("string"))).alias("mix_order"))
    # Rows that repeat an id share an order; their places split them over tasks.
    out = out.repartitionByRange("mix_order", "place").sortWithinPartitions("mix_order", "place")
    return out.select("doc.*", "mix_rate", "mix_copy", "mix_order")
