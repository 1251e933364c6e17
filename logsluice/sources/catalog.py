"""What a store of raw events offers: indexes, sourcetypes, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def indexes(events: DataFrame) -> DataFrame:
    return events.select("index_name").distinct()


def sourcetypes(events: DataFrame, index: str, since: str, until: str) -> DataFrame:
    """Sourcetypes of an index in a time range with their number of events and first and last time."""
    return _in_range(events.filter(F.col("index_name") == index), since, until).filter(
        F.col("sourcetype").isNotNull() & (F.col("sourcetype") != "")
    ).groupBy("sourcetype").agg(
        F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _in_range(events: DataFrame, since: str, until: str) -> DataFrame:
    return events.filter(
        (F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))


def latest_sample(
    events: DataFrame, index: str, sourcetype: str, since: str, until: str, n: int = 1,
) -> DataFrame:
    """The last n events of an index and sourcetype in a time range."""
    wanted = events.filter((F.col("index_name") == index) & (F.col("sourcetype") == sourcetype))
    return _in_range(wanted, since, until).orderBy(F.col("ts").desc(), "event_id").limit(n)


def sample_per_sourcetype(events: DataFrame, n: int = 1, key: str = "event_id") -> DataFrame:
    """The last n events of every sourcetype.

    The rank filter limits each sourcetype on the map side, so only n rows per sourcetype and partition
    are shuffled, and those carry their events with them.
    """
    order = Window.partitionBy("sourcetype").orderBy(F.col("ts").desc(), key)
    return events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def provenance(source: Column) -> dict[str, Column]:
    """Parts of a source tag ``kind``, ``kind:name`` or ``kind:index:sourcetype``."""
    parts = F.split(source, ":")
    part = lambda i: F.get(parts, i)
    three = F.size(parts) >= 3
    return {
        "kind": part(0),
        "name": F.when(~three, part(1)),
        "index_name": F.when(three, part(1)),
        "sourcetype": F.when(three, part(2)),
    }


def existing_columns(columns: Sequence[str], prefixes: Sequence[str], names: Sequence[str]) -> list[str]:
    """Columns that are fields, not internals of the store."""
    return [c for c in columns if not c.startswith(tuple(prefixes)) and c not in names]
