"""Streams of raw events through a rule specification into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logsluice import scratch_dir
from logsluice.plans.apply import apply
from logsluice.plans.spec import OnboardingSpec


def stream_table(
    spark: SparkSession, folder: str, name: str, max_files: int | None = None, max_bytes: str | None = None,
) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream; the schema is that of the table.

    ``max_files`` and ``max_bytes`` bound a batch.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    for option, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        if value is not None:
            reader = reader.option(option, value)
    # A stream takes no path of a single file, but a pattern that only this file matches.
    return reader.parquet(f"{folder}/{name}.parque[t]")


def write_table(
    stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
    available_now: bool = True, interval: str = "1 minute",
) -> StreamingQuery:
    """Append to a parquet table. The file sink commits each batch once, so a restarted query
    neither loses nor repeats rows."""
    writer = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def onboard(
    lines: DataFrame, spec: OnboardingSpec, path: str, checkpoint: str, available_now: bool = True,
    partition_by: list[str] | None = None,
) -> StreamingQuery:
    """Extract, time, alias and redact a stream; the transformation is that of a batch."""
    return write_table(apply(lines, spec), path, checkpoint, partition_by, available_now)


def run_to_table(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Process what is there, then read the written table. State and output live in the shared
    scratch folder, not on one machine."""
    path, checkpoint = scratch_dir(spark, label), scratch_dir(spark, f"{label}-state")
    write_table(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
