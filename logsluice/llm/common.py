"""Helpers of the operators: lineage cuts, checked broadcasts, text as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# A side of at most so many rows may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
# Texts are turned into arrays in pieces of about so many bytes, whole documents each.
PIECE_BYTES = 1 << 18

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; later reads don't recompute them."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if its rows, counted, are few; else as it is.

    ``df`` should be cheap to count: narrow rows, cut before.
    """
    return F.broadcast(df) if df.count() <= rows else df


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; NULL is empty."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def text_pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a batch with their texts, so that only one piece of it is held twice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy()
    for lo, hi in pieces(sizes, limit):
        yield lo, hi, binary_column(batch.slice(lo, hi - lo), name)


def pieces(sizes: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit``; a larger row is a range of its own."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
