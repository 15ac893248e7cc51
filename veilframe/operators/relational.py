"""Joins and groupings whose null rules differ from SQL's defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which null equals null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that matches nulls and keeps the keys of the left side once."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def distinct_per_row(df: DataFrame, keys: list[str], counted: str, name: str) -> DataFrame:
    """Each row with the number of distinct `counted` in its group: an aggregate
    joined back, since distinct counts have no window form."""
    sizes = df.groupBy(*keys).agg(F.countDistinct(counted).alias(name))
    return null_safe_join(df, sizes, keys)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), nulls as <null>."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<null>")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, the smallest of those that tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_count"))
    return counts.orderBy(F.desc("_count"), F.asc(column)).limit(1).select(F.col(column).alias("mode"))


def matching(df: DataFrame, filters: dict[str, object], time_format: str = "HH:mm") -> DataFrame:
    """Rows that equal each value, or are in each list; times are compared as HH:mm."""
    for name, wanted in filters.items():
        is_time = dict(df.dtypes)[name].startswith("timestamp")
        column = F.date_format(name, time_format) if is_time else F.col(name)
        many = isinstance(wanted, (list, tuple, set))
        values = list(wanted) if many else [wanted]
        df = df.where(column.isin([str(v) for v in values] if is_time else values))
    return df


def share_of_total(df: DataFrame, by: str, weight: str) -> DataFrame:
    """Each value's share of all weight, in percent to two decimals, largest first."""
    sums = df.groupBy(by).agg(F.sum(weight).alias("w"))
    total = sums.agg(F.sum("w").alias("t"))
    share = F.rint(F.try_divide(F.col("w") * 100.0, F.col("t").cast("double")) * 100.0) / 100.0
    return sums.crossJoin(F.broadcast(total)).select(by, share.alias("share")).orderBy(F.desc("share"), by)


def weighted_mean(df: DataFrame, by: str, value: str, weight: str, name: str) -> DataFrame:
    kept = df.where(F.col(by).isNotNull() & F.col(value).isNotNull() & F.col(weight).isNotNull())
    return kept.groupBy(by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.col(weight).cast("double"))).alias(name))
