"""Windowed measures over events. Each works on a table and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LATENESS = "10 minutes"


def with_event_time(df: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Event time as TIMESTAMP (streams accept no other type) with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def rate_per_window(
    df: DataFrame, by: list[str | Column], ts: str = "ts", size: str = "1 hour", slide: str | None = None,
    value: Column | None = None,
) -> DataFrame:
    """Count, or sum of ``value``, per window and group."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    measure = F.count("*") if value is None else F.sum(value)
    return df.groupBy(window.alias("w"), *by).agg(measure.alias("items"))


def flat_window(df: DataFrame) -> DataFrame:
    """Window bounds as columns."""
    return df.select(
        F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"),
        *[c for c in df.columns if c != "w"])


def failure_rate(
    df: DataFrame, failed: Column, ts: str = "ts", size: str = "1 hour", slide: str = "15 minutes",
) -> DataFrame:
    """Share of failed events per sliding window."""
    return df.groupBy(F.window(ts, size, slide).alias("w")).agg(
        F.count("*").alias("events"), F.count_if(failed).alias("failures"),
        F.round(F.count_if(failed) / F.count("*"), 4).alias("rate"))


def drop_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One event per key within the watermark; a table keeps one event per key."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def sessions(df: DataFrame, by: list[str], ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions that end after a gap.

    On a table, sessions are first built per hour and then joined up: a key with most of the events
    is spread over its hours, and only a few rows per hour meet in the second step.
    """
    if df.isStreaming:
        return df.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    parts = df.groupBy(*by, F.date_trunc("hour", ts).alias("_hour"), F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("events"))
    in_time = Window.partitionBy(*by).orderBy("w.start")
    opens = F.coalesce(F.col("w.start") >= F.lag("w.end").over(in_time), F.lit(True))
    numbered = parts.withColumn("_opens", opens.cast("int")).withColumn(
        "_session", F.sum("_opens").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_session").agg(
        F.struct(F.min("w.start").alias("start"), F.max("w.end").alias("end")).alias("w"),
        F.sum("events").alias("events")).select(*by, "w", "events")


FORGET_AFTER = "7 days"


def first_seen(
    df: DataFrame, by: str = "sourcetype", name: str = "name", ts: str = "ts", forget: str = FORGET_AFTER,
) -> DataFrame:
    """Field names when they occur for the first time.

    On a stream a name is kept until event time has passed it by ``forget``, so names that carry data
    leave the state again; a name that comes back after that is reported once more.
    """
    if not df.isStreaming:
        return df.select(by, name).dropDuplicates([by, name])
    return df.select(by, name, ts).withWatermark(ts, forget).dropDuplicatesWithinWatermark([by, name]).select(by, name)
