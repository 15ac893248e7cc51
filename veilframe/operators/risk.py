"""Risk of raw data, and attacks on releases. Every figure is computed from its
input; a figure that has no input is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.numeric import SALT, clean, draw_key, laplace, noisy_count, percent, report, tenth, uniform
from veilframe.operators.ordered import column_quantiles
from veilframe.operators.relational import null_safe_join
from veilframe.operators.release import cell_key, mark_suppressed
from veilframe.operators.roles import Roles
from veilframe.storage import cut

# ---------------------------------------------------------------- raw data


def row_uniqueness(df: DataFrame, quasi: list[str], subscriber: str) -> DataFrame:
    """R1, one row: groups of rows under the quasi-identifiers (rows, not subscribers)."""
    groups = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n"), F.max(subscriber).alias("who"))
    people = df.agg(F.countDistinct(subscriber).alias("people"))
    out = groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("n") == 1, 1)), F.lit(0)).alias("ones"),
        F.coalesce(F.sum(F.when(F.col("n") < 5, F.col("n"))), F.lit(0)).alias("few"), F.min("n").alias("min_group_size"),
        F.countDistinct(F.when(F.col("n") == 1, F.col("who"))).alias("exposed"),
    )
    return out.crossJoin(F.broadcast(people)).select(
        "n_groups", percent(F.col("ones"), F.col("rows")).alias("pct_rows_in_groups_of_1"), percent(F.col("few"), F.col("rows")).alias("pct_rows_in_groups_lt_5"),
        "min_group_size", percent(F.col("exposed"), F.col("people")).alias("pct_subscribers_with_unique_row"),
    )


def points(df: DataFrame, subscriber: str, columns: list) -> DataFrame:
    """Distinct (sub, point) pairs; a point is a text key of its columns."""
    return df.select(F.col(subscriber).cast("string").alias("sub"), draw_key(*columns).alias("point")).where("sub is not null").distinct()


def _drawn(salt: str, *columns: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), *columns).cast("binary"))


def chosen_points(pairs: DataFrame, have: DataFrame, lengths: tuple[int, ...], sample: int, salt: str = SALT) -> DataFrame:
    """(p, target, point): for each p, `p` points of each of `sample` subscribers that
    have so many, both by hash. `have` is (sub, n), the number of points of each."""
    some = None
    for p in lengths:
        one = have.where(F.col("n") >= p).orderBy(_drawn(salt, F.lit(str(p)), F.col("sub")), "sub").limit(sample).select(F.lit(p).alias("p"), F.col("sub").alias("target"))
        some = one if some is None else some.union(one)
    met = pairs.join(F.broadcast(some), F.col("sub") == F.col("target"))
    order = Window.partitionBy("p", "target").orderBy(_drawn(salt, F.col("p").cast("string"), F.col("target"), F.col("point")), "point")
    return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("p")).select("p", "target", "point")


def _sharers(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(points, sharers): how many subscribers have all points of each distinct set.

    A subscriber's points that are in any set come together as one row, which is tested
    against the sets by their rarest point (`point`); who fits is counted as it is found."""
    wanted = sets.select(F.explode("points").alias("point")).distinct()
    mine = pairs.join(F.broadcast(wanted), "point", "left_semi").groupBy("sub").agg(F.collect_set("point").alias("mine"))
    asked = mine.select("mine", F.explode("mine").alias("point")).join(F.broadcast(sets), "point")
    has_all = (F.size("points") == 1) | (F.size(F.array_except("points", "mine")) == 0)
    return asked.where(has_all).groupBy("points").agg(F.count(F.lit(1)).alias("sharers"))


def trajectories(df: DataFrame, subscriber: str, columns: list, lengths: tuple[int, ...] = (1, 2, 3, 4), sample: int = 1000, salt: str = SALT) -> DataFrame:
    """R2 and A2: how far p known points narrow the candidates, one row for each p.

    The pairs of subscribers and points are written once, and all p share them. How many
    subscribers a point has is counted for known points only; targets with the same known
    points are one set, and candidates are never written as rows."""
    pairs = cut(points(df, subscriber, columns), "points")
    have = cut(pairs.groupBy("sub").agg(F.count(F.lit(1)).alias("n")), "have")
    known = cut(chosen_points(pairs, have, lengths, sample, salt), "known")
    often = pairs.join(F.broadcast(known.select("point").distinct()), "point", "left_semi").groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    rarest = known.join(often, "point").groupBy("p", "target").agg(F.min("n").alias("per_point"), F.min_by("point", F.struct("n", "point")).alias("point"), F.sort_array(F.collect_list("point")).alias("points"))
    rarest = cut(rarest, "rarest")
    fits = _sharers(pairs, rarest.select("point", "points").distinct()).withColumnRenamed("sharers", "all_points")
    fits = rarest.select("p", "target", "points").join(fits, "points").drop("points")
    one = fits.join(rarest.select("p", "target", "per_point"), ["p", "target"]).groupBy("p").agg(
        F.count(F.lit(1)).alias("n_sampled"), report(F.median("per_point")).alias("median_per_point"), report(F.median("all_points")).alias("median_all_points"),
        percent(F.count_if(F.col("all_points") == 1), F.count(F.lit(1))).alias("pct_unique"), report(F.avg(1.0 / F.greatest("all_points", F.lit(1)))).alias("p_target"),
    )
    steps = F.explode(F.array(*map(F.lit, lengths)))
    eligible = have.select("n", steps.alias("p")).groupBy("p").agg(F.count_if(F.col("n") >= F.col("p")).alias("n_eligible"))
    every = df.sparkSession.createDataFrame([(p,) for p in lengths], "p int")
    out = every.join(eligible, "p", "left").join(one, "p", "left")
    return out.select("p", F.coalesce("n_eligible", F.lit(0)).alias("n_eligible"), F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"), "median_per_point", "median_all_points", "pct_unique", "p_target")


def outliers(df: DataFrame, subscriber: str, volume: str, sparse: str, device: str) -> DataFrame:
    """R3, one row: subscribers that stand out by volume, tethering or device."""
    per = df.where(F.col(subscriber).isNotNull()).groupBy(subscriber).agg(F.coalesce(F.sum(clean(F.col(volume))), F.lit(0.0)).alias("total"), F.max(clean(F.col(sparse))).alias("most"))
    per = cut(per, "per")
    bound = one_quantile(per, "total", 0.99, "p99")
    alone = per.groupBy(tenth(F.col("total")).alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") == 1, 1)), F.lit(0)).alias("alone"))
    devices = df.where(F.col(device).isNotNull()).groupBy(device).agg(F.countDistinct(subscriber).alias("n"))
    thin = devices.agg(F.count(F.lit(1)).alias("n_devices"), F.count_if(F.col("n") < 5).alias("n_thin"))
    exposed = df.join(devices.where("n < 5").select(device), device, "left_semi").agg(F.countDistinct(subscriber).alias("exposed"))
    out = per.crossJoin(F.broadcast(bound)).agg(F.count(F.lit(1)).alias("n_subscribers"), F.max("p99").alias("p99"), F.max("total").alias("most"), F.count_if(F.col("total") > F.col("p99")).alias("above"), F.count_if(F.col("most") > 0).alias("any"))
    for other in (alone, thin, exposed):
        out = out.crossJoin(F.broadcast(other))
    n = F.col("n_subscribers")
    return out.select("n_subscribers", report(F.col("p99")).alias("p99"), report(F.col("most")).alias("max"), percent(F.col("above"), n).alias("pct_above_p99"), percent(F.col("alone"), n).alias("pct_unique_rounded"), percent(F.col("any"), n).alias("pct_any_tethering"), "n_devices", "n_thin", percent(F.col("exposed"), n).alias("pct_in_thin_device"))


def notes(df: DataFrame, time: str, device: str) -> DataFrame:
    """One row: whether a device column or the days are constant, so that a figure says little."""
    return df.agg((F.countDistinct(device) <= 1).alias("constant_device"), (F.countDistinct(F.to_date(time)) <= 1).alias("single_day"))


# ---------------------------------------------------------------- record release


def a1_uniqueness(record: DataFrame, roles: Roles, k: int) -> DataFrame:
    """`record` still has its key. One row; of group sizes in rows and in subscribers."""
    groups = record.groupBy(*roles.quasi).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(roles.key).alias("subs"))
    return groups.agg(
        percent(F.coalesce(F.sum(F.when(F.col("rows") == 1, 1)), F.lit(0)), F.sum("rows")).alias("pct_rows_in_groups_of_1"),
        percent(F.count_if(F.col("subs") < k), F.count(F.lit(1))).alias("pct_groups_below_k"), F.min("subs").alias("min_subscribers"),
        report(F.try_divide(F.sum(F.try_divide(F.col("rows").cast("double"), F.col("subs"))), F.sum("rows"))).alias("expected_identification"), F.count(F.lit(1)).alias("n_groups"),
    )


def a3_homogeneity(record: DataFrame, roles: Roles, flags: dict) -> DataFrame:
    """One row for each flag: groups in which everybody has one value of it."""
    names = sorted(flags)
    each = F.array(*[F.struct(F.lit(n).alias("attribute"), flags[n].alias("flag")) for n in names])
    long_ = record.select(roles.key, *roles.quasi, F.inline(each))
    groups = long_.groupBy("attribute", *roles.quasi).agg(F.countDistinct(roles.key).alias("subs"), F.countDistinct("flag").alias("l"), F.coalesce(F.max("flag"), F.lit(False)).alias("top"))
    out = groups.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_groups"), percent(F.count_if(F.col("l") <= 1), F.count(F.lit(1))).alias("pct_homogeneous"),
        percent(F.count_if((F.col("l") <= 1) & F.col("top")), F.count(F.lit(1))).alias("pct_homogeneous_true"),
        percent(F.coalesce(F.sum(F.when(F.col("l") <= 1, F.col("subs"))), F.lit(0)), F.sum("subs")).alias("pct_memberships"),
        percent(F.coalesce(F.sum(F.when((F.col("l") <= 1) & F.col("top"), F.col("subs"))), F.lit(0)), F.sum("subs")).alias("pct_memberships_true"),
        F.min("l").alias("l_min"), report(F.median("l")).alias("l_median"),
    )
    bad = groups.where((F.col("l") <= 1) & F.col("top")).select("attribute", *roles.quasi)
    exposed = null_safe_join(long_, bad, ["attribute", *roles.quasi], "left_semi").groupBy("attribute").agg(F.countDistinct(roles.key).alias("exposed"))
    whole = long_.groupBy("attribute").agg(F.countDistinct(roles.key).alias("people"), report(F.avg(F.col("flag").cast("double"))).alias("share_true"))
    out = out.join(whole, "attribute").join(exposed, "attribute", "left")
    return out.withColumn("pct_subscribers_disclosed", percent(F.coalesce("exposed", F.lit(0)), F.col("people"))).drop("exposed", "people")


def raw_quantile(raw: DataFrame, column: str, q: float) -> DataFrame:
    return one_quantile(raw, column, q, "threshold")


def one_quantile(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One row: an exact quantile of a whole column, null without values."""
    found = column_quantiles(df, {column: (clean(F.col(column)), [q])})[column]
    return df.sparkSession.createDataFrame([(found[0],)], f"{name} double")


def a4_caps(record: DataFrame, volumes: list[str]) -> DataFrame:
    """(metric, cap, pct_rows_at_cap) of each volume."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), clean(F.col(c)).alias("v")) for c in volumes])
    long_ = record.select(F.inline(each))
    caps = long_.groupBy("metric").agg(F.max("v").alias("cap"))
    return long_.join(F.broadcast(caps), "metric").groupBy("metric").agg(report(F.max("cap")).alias("cap"), percent(F.count_if(F.col("v") >= F.col("cap")), F.count(F.lit(1))).alias("pct_rows_at_cap"))


def a4_volume(record: DataFrame, raw: DataFrame, roles: Roles, volume: str, k: int, threshold: DataFrame | None = None) -> DataFrame:
    """One row: rows below k once the volume to one decimal is known too. `threshold` is the
    raw data's 95 % quantile, where it has been found."""
    threshold = raw_quantile(raw, volume, 0.95) if threshold is None else threshold
    wide = record.withColumn("_v", tenth(clean(F.col(volume)))).crossJoin(F.broadcast(threshold))
    groups = wide.groupBy(*roles.quasi, "_v").agg(F.countDistinct(roles.key).alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(clean(F.col(volume)) > F.col("threshold")).alias("heavy"), F.max("threshold").alias("threshold"))
    rows = groups.agg(F.max("threshold").alias("t"), F.sum("heavy").alias("n_heavy_rows"), F.sum("rows").alias("rows"), F.sum(F.when(F.col("n") < k, F.col("rows")).otherwise(0)).alias("below"), F.sum(F.when(F.col("n") < k, F.col("heavy")).otherwise(0)).alias("heavy_rows_below_k"), F.percentile(F.col("n"), F.lit(0.5), F.col("rows")).alias("m"))
    return rows.select(report(F.col("t")).alias("threshold"), "n_heavy_rows", percent(F.col("n_heavy_rows"), F.col("rows")).alias("pct_heavy_rows"), percent(F.col("below"), F.col("rows")).alias("pct_rows_below_k"), report(F.col("m")).alias("median_sharing"), "heavy_rows_below_k")


# ---------------------------------------------------------------- aggregate release

#: Parts that membership games are dealt over, by target; their number is fixed, as games are.
PLAYED = 32


def true_cells(prepared: DataFrame, roles: Roles) -> DataFrame:
    return prepared.groupBy(*roles.cell).agg(F.countDistinct(roles.key).alias("true_count"))


def differencing(simulated: DataFrame, roles: Roles, tolerance: int) -> DataFrame:
    """One row: hidden cells, slices that hide exactly one, and how many of those the
    true total of the slice gives away. Two hidden cells only show their sum."""
    hidden = F.col("_primary") | F.col("_secondary")
    slices = simulated.groupBy(*roles.slice).agg(
        F.count_if(hidden).alias("hidden"), (F.sum("true_count") - F.coalesce(F.sum(F.when(~hidden, F.col("published"))), F.lit(0))).alias("estimate"), F.sum(F.when(hidden, F.col("true_count"))).alias("truth"),
    )
    lone = F.col("hidden") == 1
    hit = lone & (F.abs(F.col("estimate") - F.col("truth")) <= tolerance)
    return slices.agg(F.coalesce(F.sum("hidden"), F.lit(0)).alias("suppressed_cells"), F.count_if(lone).alias("lone_slices"), F.count_if(hit).alias("recovered"))


def a5_grid(prepared: DataFrame, roles: Roles, minimum: int, bound: int, epsilons: list, tolerance: int = 2, salt: str = SALT) -> DataFrame:
    """(epsilon, secondary, suppressed_cells, lone_slices, recovered, pct_recovered)."""
    base = cut(true_cells(prepared, roles), "true")
    out = None
    for epsilon in epsilons:
        noised = base.withColumn("published", noisy_count(F.col("true_count"), cell_key(roles), bound / epsilon, salt) if epsilon else F.col("true_count"))
        for secondary in (True, False):
            one = differencing(mark_suppressed(noised, roles, minimum, secondary, "published"), roles, tolerance)
            share = F.when(F.col("suppressed_cells") > 0, percent(F.col("recovered"), F.col("suppressed_cells"))).otherwise(0.0)
            row = one.select(F.lit("none" if epsilon is None else f"{epsilon:g}").alias("epsilon"), F.lit(secondary).alias("secondary"), "*", share.alias("pct_recovered"))
            out = row if out is None else out.union(row)
    return out


def a6_membership(prepared: DataFrame, roles: Roles, bound: int, epsilons: list, targets: int = 200, trials: int = 100, salt: str = SALT) -> DataFrame:
    """Membership game by a Laplace likelihood ratio over the target's cells; a tie is
    a guess of 'in'. One row for each epsilon, with the bound e^eps / (1 + e^eps)."""
    pairs = cut(prepared.where(F.col(roles.key).isNotNull()).select(roles.key, *roles.cell).distinct(), "members")
    counts = pairs.groupBy(*roles.cell).agg(F.count(F.lit(1)).alias("true_count"))
    order = F.md5(F.concat_ws("|", F.lit(salt), F.lit("a6"), F.col(roles.key).cast("string")).cast("binary"))
    some = pairs.select(F.col(roles.key)).distinct().orderBy(order, roles.key).limit(targets)
    mine = null_safe_join(pairs.join(F.broadcast(some), roles.key), counts, roles.cell).select(F.col(roles.key).cast("string").alias("target"), cell_key(roles).alias("cell"), "true_count")
    # a game's draws are the same for each epsilon, which only scales the noise
    played = mine.repartition(PLAYED, "target").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    trial = F.col("trial").cast("string")
    drawn = played.select("target", "trial", "true_count", (uniform(F.concat_ws("|", F.lit("m"), "target", trial), salt) < 0).alias("member"), laplace(F.concat_ws("|", F.lit("n"), "target", trial, "cell"), 1.0, salt).alias("unit"))
    steps = [F.struct(F.lit("none" if e is None else f"{e:g}").alias("epsilon"), F.lit(None if e is None else float(bound) / e).cast("double").alias("scale"), F.lit(e).cast("double").alias("e")) for e in epsilons]
    games = drawn.select("*", F.inline(F.array(*steps)))
    noise = F.coalesce(F.col("unit") * F.col("scale"), F.lit(0.0))
    seen = F.when(F.col("member"), F.col("true_count")).otherwise(F.col("true_count") - 1) + noise
    each = games.select("epsilon", "scale", "e", "target", "trial", "member", F.abs(seen - F.col("true_count")).alias("far_in"), F.abs(seen - F.col("true_count") + 1).alias("far_out"))
    guess = each.groupBy("epsilon", "scale", "e", "target", "trial", "member").agg(F.sum("far_in").alias("i"), F.sum("far_out").alias("o"))
    closer = F.rint((F.col("i") - F.col("o")) * 1e6) <= 0  # a tie up to rounding is a tie
    right = F.count_if(closer == F.col("member"))
    out = guess.groupBy("epsilon", "scale", "e").agg((right * 100.0 / F.count(F.lit(1))).alias("acc"))
    limit = F.coalesce(100.0 * F.exp("e") / (1.0 + F.exp("e")), F.lit(100.0))
    return out.select("epsilon", report(F.col("scale")).alias("noise_scale"), report(F.col("acc")).alias("accuracy_pct"), report(2 * F.col("acc") - 100.0).alias("advantage_pct"), report(limit).alias("bound_pct"))


__all__ = ["a1_uniqueness", "a3_homogeneity", "a4_caps", "a4_volume", "a5_grid", "a6_membership", "differencing", "notes", "outliers", "row_uniqueness", "trajectories", "true_cells"]
