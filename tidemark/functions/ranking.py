"""Top-k with a rank column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A list at most this long is small enough to send to every executor.
BROADCAST_ROWS = 10_000


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows by `order`, numbered. The unpartitioned window sees only those k rows."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sorted_few(df: DataFrame, *order: str) -> DataFrame:
    """Sort a frame of few rows (one per run, week or month).

    One partition needs no sampling pass for range boundaries.
    """
    return df.repartition(1).sortWithinPartitions(*order)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a frame of at most `max_rows` rows for broadcast when that bound is low enough."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df
