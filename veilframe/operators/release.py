"""Releases: k-anonymous records, pseudonymous sessions, and protected cells."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.keyed import session_label
from veilframe.functions.numeric import clean, draw_key, noisy_count, percent, report, significant_columns, uniform
from veilframe.operators.ordered import column_quantiles
from veilframe.operators.relational import null_safe_join
from veilframe.operators.roles import Roles
from veilframe.operators.transforms import ReleaseConfig
from veilframe.storage import cut


class LeakError(Exception):
    """A release would show what it must not."""


# ---------------------------------------------------------------- records


def keyed(df: DataFrame, roles: Roles) -> DataFrame:
    """(quasi, _region, key) of every row: what groups and their subscribers are known by."""
    return df.select(*roles.quasi, F.coalesce(F.col(roles.region).cast("string"), F.lit("UNKNOWN")).alias("_region"), roles.key)


def large_groups(rows: DataFrame, roles: Roles, k: int) -> DataFrame:
    """(quasi, _n): distinct subscribers of the groups that have `k` of them at least.

    Rows are counted by a hash of their group first. Groups whose hash has fewer than k rows
    cannot have k subscribers, so most rows of small groups never move; hashes that collide
    only keep some more of them."""
    hashed = F.xxhash64(*roles.quasi)
    often = rows.groupBy(hashed.alias("_h")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= k).select("_h")
    some = rows.withColumn("_h", hashed).join(often, "_h", "left_semi")
    return some.groupBy(*roles.quasi).agg(F.countDistinct(roles.key).alias("_n")).where(F.col("_n") >= k)


def mark_k(df: DataFrame, roles: Roles, k: int, rows: DataFrame | None = None) -> DataFrame:
    """Rows with _escalated (area became the region) and _suppressed, before removal.

    A group counts distinct subscribers. Groups below k give up their area; groups
    that are still below k are suppressed. Key and group columns (`rows`, of a table that is
    written already) are written once; `df` is read for them and for the result, which meets
    two tables of groups that have k subscribers or took in others, never one of all groups."""
    rest = [c for c in roles.quasi if c != "area"]
    rows = cut(keyed(df, roles), "keyed") if rows is None else rows
    whole = cut(large_groups(rows, roles, k).select(*roles.quasi, F.lit(True).alias("_whole")), "whole")

    def moved(some: DataFrame) -> DataFrame:
        met = null_safe_join(some, whole, roles.quasi, "left").withColumn("_escalated", F.col("_whole").isNull())
        return met.withColumn("area_", F.when(F.col("_escalated"), F.col("_region")).otherwise(F.col("area"))).drop("_whole")

    final = [*rest, "area_"]
    sizes = cut(moved(rows).groupBy(*final).agg(F.countDistinct(roles.key).alias("_n")), "sizes")
    region = F.coalesce(F.col(roles.region).cast("string"), F.lit("UNKNOWN"))
    marked = null_safe_join(moved(df.withColumn("_region", region)), sizes, final)
    return marked.withColumn("area", F.col("area_")).withColumn("_suppressed", F.col("_n") < k).drop("_region", "area_")


def k_anonymise(df: DataFrame, roles: Roles, k: int, rows: DataFrame | None = None) -> DataFrame:
    return mark_k(df, roles, k, rows).where(~F.col("_suppressed")).drop("_escalated", "_suppressed", "_n")


def k_statistics(marked: DataFrame, roles: Roles, k: int) -> DataFrame:
    """One row about what `mark_k` did."""
    rows = marked.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(~F.col("_suppressed")).alias("rows_out"),
        F.count_if("_escalated").alias("rows_escalated"), F.count_if("_suppressed").alias("rows_suppressed"),
        F.coalesce(F.min(F.when(~F.col("_suppressed"), F.col("_n"))), F.lit(0)).alias("min_subscribers"),
        report(F.coalesce(F.median(F.when(~F.col("_suppressed"), F.col("_n"))), F.lit(0.0))).alias("median_subscribers"),
    )
    groups = marked.where(~F.col("_suppressed")).select(*roles.quasi).distinct().agg(F.count(F.lit(1)).alias("n_groups"))
    out = rows.crossJoin(F.broadcast(groups))
    return out.select(F.lit(k).alias("k"), "*", percent(F.col("rows_escalated"), F.col("rows_in")).alias("pct_escalated"), percent(F.col("rows_suppressed"), F.col("rows_in")).alias("pct_suppressed"))


def record_release(prepared: DataFrame, roles: Roles, config: ReleaseConfig) -> DataFrame:
    """Records without their key. That every group has k subscribers is counted anew
    first; with the key gone it no longer can be."""
    kept = k_anonymise(prepared, roles, config.k)
    assert_k(kept, roles, config.k, roles.key)
    return kept.drop(roles.key)


def session_release(prepared: DataFrame, roles: Roles, config: ReleaseConfig, key: bytes | None = None) -> DataFrame:
    """Records with a pseudonym under a key that is drawn here and kept nowhere. That
    every group has k subscribers is counted anew first."""
    kept = k_anonymise(prepared, roles, config.k)
    assert_k(kept, roles, config.k, roles.key)
    return kept.withColumn("session_id", session_label(key or os.urandom(32), F.col(roles.key))).drop(roles.key)


def assert_safe(df: DataFrame, roles: Roles, mode: str, raw: DataFrame | None = None) -> None:
    """Raise unless a release has no identifier, has its quasi-identifiers, and shows
    no raw place as an area."""
    banned = [c for c in (*roles.identifiers, roles.key) if c in df.columns]
    if banned:
        raise LeakError(f"{mode}: identifier columns {banned}")
    if mode in ("record", "session") and not set(roles.quasi) & set(df.columns):
        raise LeakError(f"{mode}: no quasi-identifier columns")
    if raw is not None and "area" in df.columns:
        places = raw.select(F.col(roles.place).cast("string").alias("area")).distinct()
        if not df.select("area").distinct().join(places, "area", "left_semi").isEmpty():
            raise LeakError(f"{mode}: raw places among the areas")


def assert_k(df: DataFrame, roles: Roles, k: int, key: str = "session_id") -> None:
    """Raise if a group of a session release, or of records that still have their
    key, has fewer than k subscribers."""
    if not df.groupBy(*roles.quasi).agg(F.countDistinct(key).alias("n")).where(F.col("n") < k).isEmpty():
        raise LeakError("a group is below k")


# ---------------------------------------------------------------- cells


def people(df: DataFrame, roles: Roles) -> DataFrame:
    """(cell, n_subscribers): the counts of `cells`, for which key and cell are enough."""
    return df.groupBy(*roles.cell).agg(F.countDistinct(roles.key).alias("n_subscribers"))


def cells(df: DataFrame, roles: Roles, with_rows: bool = False) -> DataFrame:
    """One row per cell: subscribers, p10/median/p90 of qualities, totals of volumes.

    Subscribers, totals and quantiles are found apart: beside a distinct count, Spark keeps
    a buffer of every other figure for each subscriber of a cell. Quantiles are taken of
    values that were counted before."""
    qualities, volumes = roles.qualities(df), roles.volumes(df)
    sums = [F.coalesce(F.sum(clean(F.col(c))), F.lit(0.0)).alias(f"{c}_total") for c in volumes]
    out = people(df, roles)
    if sums or with_rows:
        out = null_safe_join(out, df.groupBy(*roles.cell).agg(F.count(F.lit(1)).alias("n_rows"), *sums), roles.cell)
    found = []
    if qualities:
        each = F.array(*[F.struct(F.lit(c).alias("_metric"), clean(F.col(c)).alias("_v")) for c in qualities])
        counted = df.select(*roles.cell, F.inline(each)).where("_v is not null").groupBy(*roles.cell, "_metric", "_v").agg(F.count(F.lit(1)).alias("_n"))
        three = (("p10", 0.1), ("median", 0.5), ("p90", 0.9))
        at = counted.groupBy(*roles.cell, "_metric").agg(F.percentile("_v", F.array(*[F.lit(q) for _, q in three]), F.col("_n")).alias("_at"))
        wide = at.groupBy(*roles.cell).agg(*[F.max(F.when(F.col("_metric") == c, F.col("_at"))).alias(f"_at_{c}") for c in qualities])
        out = null_safe_join(out, wide, roles.cell, "left")
        found = [F.get(f"_at_{c}", F.lit(k)).alias(f"{c}_{name}") for c in qualities for k, (name, _) in enumerate(three)]
    return out.select(*roles.cell, "n_subscribers", *(["n_rows"] if with_rows else []), *found, *[f"{c}_total" for c in volumes])


def cell_key(roles: Roles):
    """The text that a cell's noise is drawn by."""
    return draw_key(F.unix_timestamp("time_bucket"), *[F.col(c) for c in roles.cell[1:]])


def add_noise(df: DataFrame, roles: Roles, epsilon: float | None, scale: float | None, salt: str) -> DataFrame:
    """`true_count` beside a noised n_subscribers; equal where there is no noise."""
    df = df.withColumn("true_count", F.col("n_subscribers"))
    if not epsilon or not scale:
        return df
    return df.withColumn("n_subscribers", noisy_count(F.col("true_count"), cell_key(roles), scale, salt))


def mark_suppressed(df: DataFrame, roles: Roles, minimum: int, secondary: bool = True, count: str = "n_subscribers") -> DataFrame:
    """Rows with _primary (below the minimum) and _secondary: in a slice that lost a
    cell, the smallest that is left, the first by key among equals."""
    df = df.withColumn("_primary", F.col(count) < minimum)
    if not secondary:
        return df.withColumn("_secondary", F.lit(False))
    rest = [F.col(c) for c in roles.cell if c not in roles.slice]
    part = Window.partitionBy(*roles.slice)
    lost = F.max("_primary").over(part)
    rank = F.row_number().over(Window.partitionBy(*roles.slice, "_primary").orderBy(F.col(count), *rest))
    return df.withColumn("_secondary", lost & ~F.col("_primary") & (rank == 1))


def contribution_bound(prepared: DataFrame, roles: Roles, q: float = 0.99) -> DataFrame:
    """One row (bound): cells that one subscriber is in, at the quantile; 1 at least."""
    per = prepared.where(F.col(roles.key).isNotNull()).select(roles.key, *roles.cell).distinct().groupBy(roles.key).agg(F.count(F.lit(1)).alias("n"))
    found = column_quantiles(cut(per, "per"), {"n": (F.col("n"), [q])})["n"][0]
    return prepared.sparkSession.createDataFrame([(max(1, int(found or 1)),)], "bound int")


def clip_contributions(prepared: DataFrame, roles: Roles, bound: int, salt: str) -> DataFrame:
    """Only `bound` cells of each subscriber, by a hashed order: with it epsilon is a
    guarantee, without it a scale of noise."""
    mine = prepared.select(roles.key, *roles.cell).distinct()
    by = uniform(draw_key(F.lit("clip"), F.col(roles.key), cell_key(roles)), salt)
    rank = F.row_number().over(Window.partitionBy(roles.key).orderBy(by, *roles.cell))
    kept = mine.withColumn("_r", rank).where(F.col("_r") <= bound).drop("_r")
    return null_safe_join(prepared, kept, [roles.key, *roles.cell], "left_semi")


def noise_scale(prepared: DataFrame, roles: Roles, config: ReleaseConfig) -> tuple[int, float | None]:
    bound = config.max_cells or contribution_bound(prepared, roles).first()["bound"]
    return bound, bound / config.epsilon if config.epsilon else None


def marked_cells(prepared: DataFrame, roles: Roles, config: ReleaseConfig) -> DataFrame:
    """Cells with noise and both suppression marks, nothing removed yet."""
    scale = None
    if config.epsilon:
        bound, scale = noise_scale(prepared, roles, config)
        if config.clip_contributions:
            prepared = clip_contributions(prepared, roles, bound, config.salt)
    noised = add_noise(cells(prepared, roles), roles, config.epsilon, scale, config.salt)
    return mark_suppressed(noised, roles, config.min_subscribers_cell)


def publish_cells(marked: DataFrame, digits: int) -> DataFrame:
    kept = marked.where(~F.col("_primary") & ~F.col("_secondary")).drop("_primary", "_secondary", "true_count")
    # a total's last digits depend on the order of its sum, and would settle ties
    doubles = [c for c, kind in kept.dtypes if kind == "double"]
    settled = significant_columns(kept, [c for c in doubles if c.endswith("_total")], 12)
    return significant_columns(settled, doubles, digits)


def aggregate_release(prepared: DataFrame, roles: Roles, config: ReleaseConfig) -> DataFrame:
    return publish_cells(marked_cells(prepared, roles, config), config.digits)


def aggregate_statistics(marked: DataFrame) -> DataFrame:
    """One row about what suppression did."""
    gone = F.col("_primary") | F.col("_secondary")
    out = marked.agg(
        F.count(F.lit(1)).alias("cells_in"), F.count_if(~gone).alias("cells_out"), F.count_if("_primary").alias("primary"), F.count_if("_secondary").alias("secondary"),
        F.coalesce(F.min(F.when(~gone, F.col("n_subscribers"))), F.lit(0)).alias("min_count"),
        report(F.coalesce(F.median(F.when(~gone, F.col("n_subscribers"))), F.lit(0.0))).alias("median_count"),
    )
    return out.withColumn("pct_suppressed", percent(F.col("primary") + F.col("secondary"), F.col("cells_in")))


def count_error(marked: DataFrame) -> DataFrame:
    """Median and mean of |noisy - true| / true over published cells with true > 0."""
    kept = marked.where(~F.col("_primary") & ~F.col("_secondary") & (F.col("true_count") > 0))
    error = F.abs(F.col("n_subscribers") - F.col("true_count")).cast("double") / F.col("true_count")
    return kept.agg(report(F.median(error)).alias("median_error"), report(F.avg(error)).alias("mean_error"))


def treatments(log: DataFrame) -> DataFrame:
    """(field, treatment): each field's actions, joined."""
    return log.groupBy("field").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("action"))), "; ").alias("treatment"))


# ---------------------------------------------------------------- sweeps


def record_sweep(prepared: DataFrame, roles: Roles, ks: list[int]) -> DataFrame:
    """Rows kept, escalated and suppressed for each k. `prepared` is a written table, of
    which key and group columns are read three times; no copy of its rows is written.

    Rows move once, to the task of their subscriber and group without its area, which no k
    changes; there they are taken for each k, and only counts of groups move on."""
    key, rest = roles.key, [c for c in roles.quasi if c != "area"]
    steps = prepared.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    rows = keyed(prepared, roles)
    whole = cut(large_groups(rows, roles, min(ks)), "whole")
    met = null_safe_join(rows, whole, roles.quasi, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    # an area that every k gives up need not move
    met = met.withColumn("area", F.when(F.col("_n") > 0, F.col("area"))).repartition(*rest, key)
    taken = met.crossJoin(F.broadcast(steps)).withColumn("_e", F.col("_n") < F.col("k")).withColumn("area", F.when(F.col("_e"), F.col("_region")).otherwise(F.col("area")))
    each = taken.groupBy("k", *rest, "area", key).agg(F.count(F.lit(1)).alias("rows"), F.count_if("_e").alias("escalated"))
    groups = each.groupBy("k", *rest, "area").agg(F.count(key).alias("_m"), F.sum("rows").alias("rows"), F.sum("escalated").alias("escalated"))
    out = groups.groupBy("k").agg(F.sum("rows").alias("rows_in"), F.sum("escalated").alias("rows_escalated"), F.sum(F.when(F.col("_m") < F.col("k"), F.col("rows")).otherwise(0)).alias("rows_suppressed"))
    return cut(out.withColumn("pct_suppressed", percent(F.col("rows_suppressed"), F.col("rows_in"))), "swept")


def aggregate_sweep(prepared: DataFrame, roles: Roles, config: ReleaseConfig, epsilons: list[float | None], bound: int) -> DataFrame:
    """Suppression and count error for each epsilon; cells are built once."""
    base = prepared.groupBy(*roles.cell).agg(F.countDistinct(roles.key).alias("true_count"))
    steps = prepared.sparkSession.createDataFrame([("none" if e is None else f"{e:g}", None if e is None else bound / e) for e in epsilons], "epsilon string, scale double")
    noised = base.crossJoin(F.broadcast(steps))
    noised = noised.withColumn("n_subscribers", F.when(F.col("scale").isNull(), F.col("true_count")).otherwise(noisy_count(F.col("true_count"), cell_key(roles), F.col("scale"), config.salt)))
    noised = noised.withColumn("_primary", F.col("n_subscribers") < config.min_subscribers_cell)
    rest = [F.col(c) for c in roles.cell if c not in roles.slice]
    rank = F.row_number().over(Window.partitionBy("epsilon", *roles.slice, "_primary").orderBy("n_subscribers", *rest))
    lost = F.max("_primary").over(Window.partitionBy("epsilon", *roles.slice))
    marked = noised.withColumn("_secondary", lost & ~F.col("_primary") & (rank == 1))
    kept = ~F.col("_primary") & ~F.col("_secondary")
    error = F.when(kept & (F.col("true_count") > 0), F.abs(F.col("n_subscribers") - F.col("true_count")).cast("double") / F.col("true_count"))
    return marked.groupBy("epsilon").agg(F.count(F.lit(1)).alias("cells_in"), F.count_if(kept).alias("cells_out"), F.count_if("_primary").alias("primary"), F.count_if("_secondary").alias("secondary"), report(F.median(error)).alias("median_error"), report(F.avg(error)).alias("mean_error"))
