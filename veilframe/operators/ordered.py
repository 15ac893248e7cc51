"""Order statistics and running totals of values that no task holds whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from veilframe.operators.relational import null_safe_join
from veilframe.storage import cut

#: First bins of a doubling of values, and equal parts that a range is cut into later.
BINS, PARTS = 256, 4096
#: Rows of a range that is sorted by value instead of being cut again.
HELD = 20_000


# ---------------------------------------------------------------- quantiles


def _bin(v: Column) -> Column:
    """A number that never falls where values grow: by sign, and BINS to each doubling."""
    place = F.floor((F.log2(F.abs(v)) + 1100.0) * BINS).cast("double")
    return F.when(F.isnan(v), float("inf")).when(v > 0, place).when(v < 0, -place).otherwise(0.0)


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], only: Column | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(by, n, at): exact quantiles of `value` by linear interpolation, in the order of
    `shares`, for each group. Nulls do not count; a group of nulls only has no row. Of
    all shares, numbered by `t`, only those are found for which `only` holds; the others
    are null.

    The rows are read twice. First they are counted by bins, whose number is fixed; then
    the values of the bins that a quantile lies in are counted and written. The rest is
    done there: a bin of more than HELD rows is cut into equal parts, until a part has one
    value or few rows. So buffers do not grow with the data.

    `near` may give, for (by, a, b), those rows of `df` that lie in such a range of their
    group, and others if it likes, where that is cheaper than to read all again."""
    binned = lambda d: d.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).withColumn("_sub", _bin(F.col("_v")))
    rows = binned(df)
    facts = [F.min("_v").alias("low"), F.max("_v").alias("high")]
    bins = cut(rows.groupBy(*by, "_sub").agg(F.count(F.lit(1)).alias("rows"), *facts).withColumn("_bin", F.lit("")), "bins")
    totals = bins.groupBy(*by).agg(F.sum("rows").alias("n"))
    each = totals.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(q)).alias("share")) for t, q in enumerate(shares)])))
    place = F.col("_q.share") * (F.col("n") - 1)
    each = each.select(*by, "n", "_q.t", F.floor(place).alias("k"), (place - F.floor(place)).alias("f")).withColumn("j", F.least(F.col("k") + 1, F.col("n") - 1))
    each = each if only is None else each.where(only)
    ends = each.select(*by, "n", "t", "f", F.posexplode(F.array("k", "j")).alias("end", "rank")).withColumn("_bin", F.lit(""))
    state, left = _open(_descend(bins, by, ends))
    if left:
        wanted = state.where("a < b").select(*by, "_bin", "_sub").distinct()
        rows = rows if near is None else binned(near(state.where("a < b").select(*by, "a", "b").distinct()))
        values = cut(null_safe_join(rows, wanted, [*by, "_sub"]).groupBy(*by, "_bin", "_v").agg(F.count(F.lit(1)).alias("_n")), "values")
    while left:
        state, left = _open(state.where("NOT a < b").union(_narrow(values, by, state.where("a < b")).select(state.columns)))
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("a")))
    both = state.groupBy(*by, "n", "t", "f").agg(at(0).alias("x"), at(1).alias("y"))
    between = F.when(F.col("f") > 0, F.col("x") * (1 - F.col("f")) + F.col("y") * F.col("f")).otherwise(F.col("x"))
    listed = both.groupBy(*by).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("t", between.alias("value")))).alias("x"))
    return listed.where("n > 0").select(*by, "n", F.array(*[F.element_at("x", F.lit(t)) for t in range(len(shares))]).alias("at"))


def _open(state: DataFrame) -> tuple[DataFrame, int]:
    """The state as a written table, and how many ranks in it still have a range of values."""
    seen = Observation()
    return cut(state.observe(seen, F.count_if(F.col("a") < F.col("b")).alias("open")), "ranges"), seen.get["open"]


def _descend(bins: DataFrame, by: list[str], state: DataFrame) -> DataFrame:
    """Each rank with the part (by `_sub`) of its bin that it lies in, counted from there:
    its rows, its least and greatest value, and whether it is to be sorted."""
    before = Window.partitionBy(*by, "_bin").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    met = null_safe_join(state.select(*by, "n", "t", "f", "end", "rank", "_bin"), placed, [*by, "_bin"])
    met = met.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("rows")))
    return met.select(
        *by, "n", "t", "f", "end", (F.col("rank") - F.col("before")).alias("rank"), F.concat_ws("/", "_bin", F.col("_sub").cast("string")).alias("_bin"), "_sub",
        F.col("low").alias("a"), F.col("high").alias("b"), (F.col("rows") <= HELD).alias("held"),
    )


def _narrow(values: DataFrame, by: list[str], state: DataFrame) -> DataFrame:
    """The open ranks in smaller ranges: of one value each where few rows are left, else
    in one of PARTS equal parts. `values` are counted (`_n`) by the bin they came from."""
    ranges = state.select(*by, "_bin", "a", "b", "held").distinct()
    root = F.array_join(F.slice(F.split("_bin", "/"), 1, 2), "/")
    v, a, b = F.col("_v"), F.col("a"), F.col("b")
    joined = null_safe_join(values.withColumnRenamed("_bin", "_root"), ranges.withColumn("_root", root), [*by, "_root"]).where((v >= a) & (v <= b))
    sub = F.when(F.col("held"), v).otherwise(F.floor((v - a) / (b - a) * PARTS).cast("double"))
    bins = joined.groupBy(*by, "_bin", sub.alias("_sub")).agg(F.sum("_n").alias("rows"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    return _descend(bins, by, state)


def column_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns, each at its own shares, all of them found
    together; a few numbers, so they come to the driver. Columns without values have
    nulls."""
    if not wanted:
        return {}
    shares = sorted({q for _, asked in wanted.values() for q in asked})
    values = {name: value.cast("double") for name, (value, _) in wanted.items()}
    long_of = lambda d, names: d.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), values[name].alias("v")) for name in names])))

    def near(ranges: DataFrame) -> DataFrame:
        """Rows with a value in a range of its column; of ranges there are few, two a share at most."""
        found = ranges.collect()
        hit = reduce(or_, [(values[r["name"]] >= F.lit(r["a"])) & (values[r["name"]] <= F.lit(r["b"])) for r in found])
        return long_of(df.where(hit), sorted({r["name"] for r in found}))

    only = F.lit(False)
    for name, (_, asked) in wanted.items():
        only |= (F.col("name") == name) & F.col("t").isin([shares.index(q) for q in asked])
    found = {r["name"]: r["at"] for r in quantiles(long_of(df, list(values)), ["name"], "v", shares, only, near).collect()}
    return {name: [found[name][shares.index(q)] if name in found else None for q in asked] for name, (_, asked) in wanted.items()}


# ---------------------------------------------------------------- running totals


def running(df: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """df plus `run_<s>`, the sum of each of `sums` over the rows up to this one in the
    group's order, `all_<s>`, that over the whole group, and `next`, the first order
    column's value in the row that follows (null in the last).

    Rows are range-partitioned by group and order. Totals run within a part; those of
    the parts before, one row for each part and group, are added. No task sees a whole
    group. Rows of equal order should be merged before: their order is not fixed."""
    ordered = [F.asc_nulls_first(c) for c in (*by, *order)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *ordered).withColumn("_part", F.spark_partition_id()), "ranged")
    each = dealt.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums], F.min(order[0]).alias("_first"))
    before, whole = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    each = each.select(
        *by, "_part", *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], *[F.sum(f"_s_{s}").over(whole).alias(f"all_{s}") for s in sums],
        F.lead("_first").over(Window.partitionBy(*by).orderBy("_part")).alias("_then"),
    )
    within = Window.partitionBy(*by, "_part").orderBy(*[F.asc_nulls_first(c) for c in order])
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"run_{s}": F.sum(s).over(upto) for s in sums} | {"next": F.lead(order[0]).over(within), "_more": F.lead(F.lit(True)).over(within)})
    joined = null_safe_join(local, each, [*by, "_part"])
    joined = joined.withColumns({f"run_{s}": F.col(f"run_{s}") + F.col(f"_b_{s}") for s in sums} | {"next": F.when(F.col("_more"), F.col("next")).otherwise(F.col("_then"))})
    return joined.drop("_part", "_more", "_then", *[f"_b_{s}" for s in sums])
