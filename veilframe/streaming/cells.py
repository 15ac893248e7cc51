"""Cells of a stream: an addition, not part of a batch release.

Each published micro-batch spends privacy budget anew; nothing here composes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cells(stream: DataFrame, time: str, keys: list[str], subscriber: str, value: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Cells of fixed windows in append mode: a window is out once the watermark has
    passed it. Subscribers are counted exactly: each one's rows of a cell are merged
    first, then its cell's subscribers; both states go when the watermark passes."""
    marked = stream.withWatermark(time, late)
    each = marked.groupBy(F.window(time, width).alias("w"), *keys, F.col(subscriber).alias("_who")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
    out = each.groupBy("w", *keys).agg(F.count("_who").alias("n_subscribers"), F.sum("_rows").alias("n_rows"), F.sum("_sum").alias("total"))
    return out.select(F.col("w.start").alias("time_bucket"), *keys, "n_subscribers", "n_rows", "total")


def publish(minimum: int, sink):
    """A foreachBatch function that hides cells below `minimum` and hands on the rest."""

    def each(batch: DataFrame, number: int) -> None:
        sink(batch.where(F.col("n_subscribers") >= minimum), number)

    return each
