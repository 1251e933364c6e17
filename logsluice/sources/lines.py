"""Raw text files as event tables, and the table sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RAW_SCHEMA = "value string"


def _as_events(lines: DataFrame, sourcetype: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    return lines.filter(F.trim("value") != "").select(
        F.col("value").alias("raw"), F.lit(sourcetype).alias("sourcetype"),
        F.concat(F.lit("file:"), F.element_at(F.split(path, "/"), -1)).alias("source"))


def read_lines(spark: SparkSession, path: str, sourcetype: str) -> DataFrame:
    """One row per non-blank line; gzip and other codecs by file name."""
    return _as_events(spark.read.text(path), sourcetype)


def stream_lines(spark: SparkSession, path: str, sourcetype: str, files_per_batch: int = 1000) -> DataFrame:
    """The same from a folder that receives files."""
    return _as_events(
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), sourcetype)


def read_delimited(
    spark: SparkSession, path: str, schema: str | None = None, sep: str = ",",
) -> DataFrame:
    """Delimited files with one header line each; quotes, doubled quotes and line breaks inside
    quotes. Without a schema all columns are text, taken from the header alone."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def csv_fields(raw: Column, schema: str, sep: str = ",") -> Column:
    """One delimited line as a struct; a missing or empty trailing column is NULL."""
    return F.from_csv(raw, schema, {"sep": sep, "quote": '"', "escape": '"'})


def paste(spark: SparkSession, text: str, sourcetype: str = "paste") -> DataFrame:
    """Text from an editor as events: the size of a screen, not of a data set."""
    rows = [(line, sourcetype, "paste") for line in text.split("\n") if line.strip()]
    return spark.createDataFrame(rows, "raw string, sourcetype string, source string")


def write_events(df: DataFrame, path: str, by: str = "sourcetype", mode: str = "append") -> None:
    """Write a table partitioned by sourcetype. AQE's rebalancing splits a sourcetype that holds
    much of the data over several writers and keeps small ones in one file each."""
    df.hint("rebalance", by).write.partitionBy(by).mode(mode).parquet(path)
