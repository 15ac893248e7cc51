"""Profiles of a usage log: small aggregates, never values of identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.numeric import clean, quantile, report
from veilframe.operators.ordered import quantiles
from veilframe.operators.relational import mode_of, value_counts


def base(df: DataFrame) -> DataFrame:
    """(column, dtype, null_rate, n_distinct) of every column, in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), report(F.avg(F.col(c).isNull().cast("double"))).alias("null_rate"), F.countDistinct(c).alias("n_distinct")) for c, kind in df.dtypes]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min_length, max_length, mode_length, share_all_digits): shapes only."""
    out = None
    for c in columns:
        text = F.col(c).cast("string")
        shape = df.where(F.col(c).isNotNull()).select(F.length(text).alias("n"), text.rlike("^[0-9]+$").cast("double").alias("d"))
        row = shape.agg(F.min("n").alias("min_length"), F.max("n").alias("max_length"), report(F.avg("d")).alias("share_all_digits"))
        row = row.crossJoin(F.broadcast(mode_of(shape, "n").agg(F.max("mode").alias("mode_length")))).select(F.lit(c).alias("column"), "min_length", "max_length", "mode_length", "share_all_digits")
        out = row if out is None else out.union(row)
    return out


def numerics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, p1, p5, p50, p95, p99, min, max, share_zero)."""
    out = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), clean(F.col(c)).alias("v")) for c in columns])))
    named = ("p1", "p5", "p50", "p95", "p99")
    found = quantiles(out, ["column"], "v", [int(n[1:]) / 100 for n in named]).select(F.col("column").alias("_c"), "at")
    facts = out.groupBy("column").agg(report(F.min("v")).alias("min"), report(F.max("v")).alias("max"), report(F.avg((F.col("v") == 0).cast("double"))).alias("share_zero"))
    joined = facts.join(found, F.col("column") == F.col("_c"), "left")
    return joined.select("column", *[report(F.get("at", F.lit(k))).alias(n) for k, n in enumerate(named)], "min", "max", "share_zero")


def categoricals(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) with nulls as <null>."""
    parts = [value_counts(df, c).select(F.lit(c).alias("column"), "value", "n") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def spread(df: DataFrame, column: str) -> list:
    return [report(f).alias(f"{column}_{n}") for n, f in (("min", F.min(column)), ("p5", quantile(F.col(column), 0.05)), ("p50", quantile(F.col(column), 0.5)), ("p95", quantile(F.col(column), 0.95)), ("max", F.max(column)))]


def places(df: DataFrame, place: str, subscriber: str) -> DataFrame:
    """One row: spreads over places of rows and of subscribers, and thin places."""
    per = df.where(F.col(place).isNotNull()).groupBy(place).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(subscriber).alias("subs"))
    return per.agg(*spread(per, "rows"), *spread(per, "subs"), F.count_if(F.col("subs") < 5).alias("n_thin"))


def times(df: DataFrame, time: str) -> DataFrame:
    """One row: first and last time as epoch seconds, and the most common gap."""
    from pyspark.sql import Window

    stamps = df.select(time).where(F.col(time).isNotNull()).distinct()
    gaps = stamps.select((F.unix_timestamp(time) - F.lag(F.unix_timestamp(time)).over(Window.orderBy(time))).alias("gap"))
    ends = df.agg(F.unix_timestamp(F.min(time)).alias("first"), F.unix_timestamp(F.max(time)).alias("last"))
    return ends.crossJoin(F.broadcast(mode_of(gaps, "gap").agg(F.max("mode").alias("gap_seconds"))))


def structure(df: DataFrame, subscriber: str, sim: str, device: str, time: str) -> DataFrame:
    """One row about subscribers, SIMs, devices and days."""
    per = df.where(F.col(subscriber).isNotNull()).groupBy(subscriber).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(sim).alias("sims"))
    one = per.agg(F.count(F.lit(1)).alias("n_subscribers"), F.min("rows").alias("rows_min"), report(quantile(F.col("rows"), 0.5)).alias("rows_p50"), report(quantile(F.col("rows"), 0.95)).alias("rows_p95"), F.max("rows").alias("rows_max"), report(F.avg((F.col("sims") > 1).cast("double"))).alias("share_multiple_sims"))
    sims = df.where(F.col(sim).isNotNull()).groupBy(sim).agg(F.countDistinct(subscriber).alias("n")).agg(report(F.avg((F.col("n") > 1).cast("double"))).alias("share_shared_sims"))
    per_device = df.where(F.col(device).isNotNull()).groupBy(device).agg(F.countDistinct(subscriber).alias("per_device"))
    devices = per_device.agg(F.count(F.lit(1)).alias("n_devices"), *spread(per_device, "per_device"), F.count_if(F.col("per_device") < 5).alias("n_thin_devices"))
    days = df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("d")).agg(F.countDistinct(subscriber).alias("n")).agg(F.count(F.lit(1)).alias("n_days"), report(quantile(F.col("n"), 0.5)).alias("per_day_p50"))
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    for part in (sims, devices, days, rows):
        one = one.crossJoin(F.broadcast(part))
    return one
