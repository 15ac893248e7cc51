"""The six preparing transforms of a release, each DataFrame to DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from veilframe.functions.numeric import SALT, clean, significant_columns
from veilframe.operators.ordered import column_quantiles, running
from veilframe.operators.relational import mode_of
from veilframe.operators.roles import Roles
from veilframe.storage import cut

OTHER = "OTHER"


@dataclass(frozen=True)
class ReleaseConfig:
    """Parameters of a release."""

    k: int = 10
    bucket_minutes: int | None = 15
    area_mode: str = "enb_tokenised"
    min_subscribers_area: int = 25
    min_subscribers_category: int = 25
    min_subscribers_cell: int = 10
    winsorise: tuple[float, float] = (0.01, 0.99)
    top_code: float = 0.99
    digits: int = 3
    epsilon: float | None = 1.0
    max_cells: int | None = None
    clip_contributions: bool = False
    salt: str = SALT

    def __post_init__(self) -> None:
        if self.area_mode not in ("enb_tokenised", "province"):
            raise ValueError(f"unknown area mode: {self.area_mode}")
        if self.k < 1 or self.digits < 1 or not 0 <= self.winsorise[0] <= self.winsorise[1] <= 1:
            raise ValueError("k, digits or quantiles out of range")
        if self.epsilon is not None and self.epsilon <= 0:
            raise ValueError("epsilon must be above 0, or None")


def drop_identifiers(df: DataFrame, roles: Roles) -> DataFrame:
    """The subscriber key under an inner name; every identifier column gone."""
    return df.withColumn(roles.key, F.col(roles.subscriber)).drop(*roles.identifiers)


def native_gap(df: DataFrame, time: str) -> DataFrame:
    """One row (minutes): the most common gap between distinct times, at least 1.

    The window runs over distinct times, of which a log has few."""
    stamps = df.select(time).where(F.col(time).isNotNull()).distinct()
    seconds = F.col(time).cast("double") - F.lag(F.col(time).cast("double")).over(Window.orderBy(time))
    found = mode_of(stamps.select(seconds.alias("gap")), "gap")
    return found.agg(F.greatest(F.lit(1), F.coalesce(F.max(F.rint(F.col("mode") / 60.0)), F.lit(1)).cast("int")).alias("minutes"))


def effective_bucket(df: DataFrame, time: str, configured: int | None) -> DataFrame:
    """One row (effective, native): the coarser of the configured and the native gap."""
    native = native_gap(df, time).withColumnRenamed("minutes", "native")
    chosen = F.col("native") if configured is None else F.greatest(F.lit(configured), F.col("native"))
    return native.select(chosen.alias("effective"), "native")


def floor_time(column: str, minutes: int):
    """Fixed-width floor counted from the epoch; null stays null."""
    width = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(column)) / width) * width)


def bucket_time(df: DataFrame, roles: Roles, minutes: int) -> DataFrame:
    return df.withColumn("time_bucket", floor_time(roles.time, minutes)).drop(roles.time)


def subscribers_by(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(column, value, subs): subscribers of each value that is not null, of all columns
    in one pass over the rows."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(*[F.grouping(c).alias(f"_g_{c}") for c in columns], F.countDistinct(key).alias("subs"))
    shown = [F.when(F.col(f"_g_{c}") == 0, F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c in columns]
    return sets.select(F.coalesce(*shown).alias("_x"), "subs").select("_x.column", "_x.value", "subs").where("value is not null")


def area_tokens(counts: DataFrame, place: str, minimum: int, salt: str = SALT) -> DataFrame:
    """(value, token) of the places that keep a token of their own, numbered in hashed
    order by running totals over ranges of it. `counts` is a result of `subscribers_by`."""
    kept = counts.where((F.col("column") == place) & (F.col("subs") >= minimum))
    digest = F.md5(F.concat(F.lit(salt + "|"), F.col("value")).cast("binary"))
    numbered = running(kept.select("value", digest.alias("_h"), F.lit(1).alias("_one")), [], ["_h", "value"], ["_one"])
    return numbered.select("value", F.format_string("A%04d", F.col("run__one")).alias("token"))


def build_area(df: DataFrame, roles: Roles, mode: str, minimum: int, salt: str = SALT, tokens: DataFrame | None = None) -> DataFrame:
    """place -> area: a token, or <region>_OTHER where it has few subscribers. A null
    place has a null area; a null region reads UNKNOWN. In province mode the region."""
    region = F.coalesce(F.col(roles.region).cast("string"), F.lit("UNKNOWN"))
    if mode == "province":
        return df.withColumn("area", region).drop(roles.place)
    if tokens is None:
        tokens = area_tokens(subscribers_by(df, [roles.place], roles.key), roles.place, minimum, salt)
    joined = df.join(tokens, df[roles.place].cast("string") == tokens["value"], "left")
    area = F.when(F.col(roles.place).isNotNull(), F.coalesce("token", F.concat(region, F.lit("_" + OTHER))))
    return joined.withColumn("area", area).drop("value", "token", roles.place)


def fold_rare(df: DataFrame, roles: Roles, minimum: int, counts: DataFrame | None = None) -> DataFrame:
    """Category values with fewer than `minimum` subscribers become OTHER."""
    counts = subscribers_by(df, list(roles.categories), roles.key) if counts is None else counts
    for column in roles.categories:
        rare = counts.where((F.col("column") == column) & (F.col("subs") < minimum)).select("value")
        joined = df.join(rare, df[column].cast("string") == rare["value"], "left")
        df = joined.withColumn(column, F.when(F.col("value").isNotNull(), F.lit(OTHER)).otherwise(F.col(column))).drop("value")
    return df


#: The least and the greatest value that a column may keep; None where it has none.
Limits = dict[str, tuple[float | None, float | None]]


def find_limits(df: DataFrame, qualities: list[str], volumes: list[str], low: float, high: float, cap: float) -> Limits:
    """Limits of all metrics, found together: quantiles of qualities, and of the volumes
    above 0 (a volume without any is capped at 0)."""
    wanted = {c: (clean(F.col(c)), [low, high]) for c in qualities} | {c: (F.when(clean(F.col(c)) > 0, clean(F.col(c))), [cap]) for c in volumes}
    found = column_quantiles(df, wanted)
    return {c: (found[c][0], found[c][1]) for c in qualities} | {c: (None, 0.0 if found[c][0] is None else found[c][0]) for c in volumes}


def outside(column: str, limits: Limits) -> Column:
    """Whether a value will be changed by its limits."""
    low, high = (F.lit(x).cast("double") for x in limits[column])
    return F.coalesce(clean(F.col(column)) < low, F.lit(False)) | F.coalesce(clean(F.col(column)) > high, F.lit(False))


def limited(df: DataFrame, limits: Limits, digits: int) -> DataFrame:
    """Each column within its limits, and rounded; NaN becomes null."""
    new = {}
    for c, (low, high) in limits.items():
        value = clean(F.col(c))
        value = value if low is None else F.greatest(value, F.lit(low))
        value = value if high is None else F.least(value, F.lit(high))
        new[c] = F.when(clean(F.col(c)).isNotNull(), value)
    return significant_columns(df.withColumns(new), list(new), digits) if new else df


def winsorise(df: DataFrame, columns: list[str], low: float, high: float, digits: int) -> DataFrame:
    """Clip each column to its own quantiles, all found together, and round."""
    return limited(df, find_limits(df, columns, [], low, high, high), digits)


def top_code(df: DataFrame, columns: list[str], q: float, digits: int) -> DataFrame:
    """Cap each column at the quantile of its values above 0 (0 if it has none), and round."""
    return limited(df, find_limits(df, [], columns, q, q, q), digits)


@dataclass(frozen=True)
class Source:
    """A usage log without its identifiers, written once, and what preparing needs to
    know of it: the native gap in minutes, subscribers by category, tokens of places, and
    limits of metrics. Releases that differ in bucket or area mode share it."""

    rows: DataFrame
    native: int
    counts: DataFrame
    tokens: DataFrame
    limits: Limits
    qualities: list[str]
    volumes: list[str]


def read_source(df: DataFrame, roles: Roles, config: ReleaseConfig) -> Source:
    """One read of `df`; the statistics are read from what it wrote."""
    qualities, volumes = roles.qualities(df), roles.volumes(df)
    rows = cut(drop_identifiers(df, roles), "base")
    native = native_gap(rows, roles.time).first()["minutes"]
    every = cut(subscribers_by(rows, [roles.place, *roles.categories], roles.key), "counts")
    tokens = cut(area_tokens(every, roles.place, config.min_subscribers_area, config.salt), "tokens")
    # places are many: beside them the few categories would look too large to be broadcast,
    # and all rows would be shuffled and sorted by each category
    counts = cut(every.where(F.col("column") != roles.place), "categories")
    limits = find_limits(rows, qualities, volumes, *config.winsorise, config.top_code)
    return Source(rows, native, counts, tokens, limits, qualities, volumes)


def prepare(df: DataFrame, roles: Roles, config: ReleaseConfig) -> DataFrame:
    """All six transforms in order. The bucket is not made finer than the data's own.

    The source is read once: it is written without its identifiers, and statistics are
    read from there. The result is a written table too, for all releases of it."""
    return prepare_from(read_source(df, roles, config), roles, config)[0]


def prepare_cells(df: DataFrame, roles: Roles, config: ReleaseConfig) -> DataFrame:
    """The columns (key, *roles.cell) of `prepare`, row by row, for figures that only ask
    who is in which cell. Cells stand on time, region and categories, so places are not
    counted, metrics have no limits to find, and neither is written."""
    rows = cut(df.select(F.col(roles.subscriber).alias(roles.key), roles.time, roles.region, *roles.categories), "base")
    return cell_rows(rows, roles, config)


def cell_rows(rows: DataFrame, roles: Roles, config: ReleaseConfig, metrics: tuple[str, ...] = ()) -> DataFrame:
    """The columns (key, *roles.cell, *metrics) of `prepare` over rows that are written
    and have their key already. The metrics are qualities."""
    native = native_gap(rows, roles.time).first()["minutes"]
    minutes = native if config.bucket_minutes is None else max(config.bucket_minutes, native)
    counts = cut(subscribers_by(rows, list(roles.categories), roles.key), "categories")
    folded = rows.transform(bucket_time, roles, minutes).transform(fold_rare, roles, config.min_subscribers_category, counts)
    limits = find_limits(rows, list(metrics), [], *config.winsorise, config.top_code)
    return limited(folded.select(roles.key, *roles.cell, *metrics), limits, config.digits)


def minutes_of(source: Source, configured: int | None) -> int:
    """The bucket in use: not finer than the data's own."""
    return source.native if configured is None else max(configured, source.native)


def place_rows(source: Source, roles: Roles, config: ReleaseConfig) -> DataFrame:
    """The source's rows with areas and folded categories; the bucket is still to come."""
    placed = build_area(source.rows, roles, config.area_mode, config.min_subscribers_area, config.salt, source.tokens)
    return fold_rare(placed, roles, config.min_subscribers_category, source.counts)


def prepare_from(source: Source, roles: Roles, config: ReleaseConfig) -> tuple[DataFrame, DataFrame]:
    """`prepare` of a source that has been read, and (field, action, rows_affected): what
    it changed. The counts are observed while the prepared table is written, so that the
    log costs no job. `config` may differ from the source's in bucket and area mode."""
    limits = source.limits
    placed = bucket_time(place_rows(source, roles, config), roles, minutes_of(source, config.bucket_minutes))
    seen = Observation()
    named = {"area": F.col("area").endswith("_" + OTHER)} | {c: F.col(c) == OTHER for c in roles.categories} | {c: outside(c, limits) for c in limits}
    watched = placed.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(f"n_{c}") for c, v in named.items()])
    prepared = cut(limited(watched, limits, config.digits), "prepared")
    n = seen.get
    entries = [(roles.subscriber, "dropped", n["rows"]), (roles.time, "floored", n["rows"]), (roles.place, "folded", n["n_area"])]
    entries += [(c, "folded", n[f"n_{c}"]) for c in roles.categories] + [(c, "winsorised", n[f"n_{c}"]) for c in source.qualities] + [(c, "top-coded", n[f"n_{c}"]) for c in source.volumes]
    return prepared, prepared.sparkSession.createDataFrame(entries, "field string, action string, rows_affected long")
