"""The star-schema tables seen as a usage log, for queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.roles import Roles
from veilframe.operators.transforms import ReleaseConfig

ROLES = Roles()
DAY = 1440
#: Releases over the tables: quarters for cells, years for records.
CELLS = ReleaseConfig(k=10, bucket_minutes=91 * DAY, min_subscribers_area=25, min_subscribers_category=25, min_subscribers_cell=10, epsilon=None)
NOISED = ReleaseConfig(k=10, bucket_minutes=91 * DAY, min_subscribers_area=25, min_subscribers_category=25, min_subscribers_cell=10, epsilon=1.0, max_cells=39)
RECORDS = ReleaseConfig(k=10, bucket_minutes=364 * DAY, min_subscribers_area=25, min_subscribers_category=25, epsilon=None)
SMALL = ReleaseConfig(k=3, bucket_minutes=364 * DAY, min_subscribers_area=3, min_subscribers_category=3, min_subscribers_cell=3, epsilon=None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: who, when, where, by which access, and metrics."""
    lines, orders, customers, nations, regions = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    placed = customers.join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey).join(F.broadcast(regions), nations.n_regionkey == regions.r_regionkey)
    # orders meet customers first, so that lines, of which there are most, move once
    joined = lines.join(orders.join(placed, orders.o_custkey == placed.c_custkey), lines.l_orderkey == orders.o_orderkey)
    text = lambda c: F.col(c).cast("string")
    return joined.select(
        text("o_custkey").alias("msisdn"), F.concat(text("o_custkey"), F.lit("-"), F.col("o_orderstatus")).alias("imsi"), F.concat(F.lpad(text("l_suppkey"), 8, "0"), text("o_custkey")).alias("imei"), F.lpad(text("l_suppkey"), 8, "0").alias("tac"),
        F.col("o_orderdate").cast("timestamp").alias("time_start"), text("l_partkey").alias("enb"), F.col("n_name").alias("nation"), F.col("r_name").alias("province"),
        F.col("l_returnflag").alias("radio_access_type"), F.col("o_orderpriority").alias("application_category"),
        F.col("l_quantity").cast("double").alias("tp_dl_avg"), F.col("l_tax").cast("double").alias("cont_rtt_radio_avg"), F.col("l_discount").cast("double").alias("http_sr_avg"),
        F.col("l_extendedprice").cast("double").alias("data_GB_sum"), F.col("l_discount").cast("double").alias("tethering_data_GB_dl_sum"),
        F.rint(F.col("l_extendedprice").cast("double") * F.col("l_tax").cast("double")).alias("im_video_GB_sum"),
    )


def epochs(df: DataFrame) -> DataFrame:
    """Timestamps as epoch seconds, for results that are compared across engines."""
    return df.withColumns({c: F.unix_timestamp(c) for c, kind in df.dtypes if kind == "timestamp"})


# ---------------------------------------------------------------- SQL twins

USAGE = """u AS (
  SELECT o_custkey::VARCHAR AS msisdn, o_custkey::VARCHAR || '-' || o_orderstatus AS imsi, lpad(l_suppkey::VARCHAR, 8, '0') || o_custkey::VARCHAR AS imei,
         lpad(l_suppkey::VARCHAR, 8, '0') AS tac, o_orderdate AS time_start, epoch(o_orderdate)::BIGINT AS ts, l_partkey::VARCHAR AS enb, n_name AS nation, r_name AS province,
         l_returnflag AS radio_access_type, o_orderpriority AS application_category, l_quantity::DOUBLE AS tp_dl_avg, l_tax::DOUBLE AS cont_rtt_radio_avg,
         l_discount::DOUBLE AS http_sr_avg, l_extendedprice::DOUBLE AS data_GB_sum, l_discount::DOUBLE AS tethering_data_GB_dl_sum,
         round_even(l_extendedprice::DOUBLE * l_tax::DOUBLE, 0) AS im_video_GB_sum
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

METRICS = ("tp_dl_avg", "cont_rtt_radio_avg", "http_sr_avg")
VOLUMES = ("data_GB_sum", "tethering_data_GB_dl_sum", "im_video_GB_sum")
CELL = "time_bucket, province, radio_access_type, application_category"
QUASI = "time_bucket, area, radio_access_type, application_category"


def sig(x: str, digits: int) -> str:
    x = f"CAST({x} AS DOUBLE)"
    d = f"({digits - 1} - floor(log10(nullif(abs({x}), 0))))"
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 OR isinf({x}) THEN {x} WHEN {d} >= 0 THEN round_even({x} * pow(10.0, {d}), 0) / pow(10.0, {d}) ELSE round_even({x} / pow(10.0, -({d})), 0) * pow(10.0, -({d})) END)"


def r6(x: str) -> str:
    return sig(x, 6)


def pct(part: str, whole: str) -> str:
    return r6(f"(CAST({part} AS DOUBLE) * 100.0 / nullif(CAST({whole} AS DOUBLE), 0))")


def bucket(seconds: int) -> str:
    return f"(floor(ts / {seconds}.0) * {seconds})::BIGINT"


def noise(key: str, scale: str) -> str:
    u = f"((('0x' || substr(md5('42|' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0 - 0.5)"
    return f"(-({scale}) * sign({u}) * ln(1.0 - 2.0 * abs({u})))"


def noisy(count: str, key: str, scale: str) -> str:
    return f"greatest(0, round_even({count}::DOUBLE + {noise(key, scale)}, 0))::BIGINT"


CELL_KEY = "(time_bucket::VARCHAR || '|' || province || '|' || radio_access_type || '|' || application_category)"


def prepared(config: ReleaseConfig) -> str:
    """CTEs u ... p: the six transforms in SQL."""
    width, low, high = config.bucket_minutes * 60, *config.winsorise
    bounds = ", ".join(f"quantile_cont({c}, {low}) AS lo_{c}, quantile_cont({c}, {high}) AS hi_{c}" for c in METRICS)
    caps = ", ".join(f"coalesce(quantile_cont({c}, {config.top_code}) FILTER ({c} > 0), 0) AS cap_{c}" for c in VOLUMES)
    clipped = ", ".join(f"{sig(f'least(greatest({c}, lo_{c}), hi_{c})', config.digits)} AS {c}" for c in METRICS)
    capped = ", ".join(f"{sig(f'least({c}, cap_{c})', config.digits)} AS {c}" for c in VOLUMES)
    folded = ", ".join(f"CASE WHEN {c} IN (SELECT {c} FROM u WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(DISTINCT msisdn) < {config.min_subscribers_category}) THEN 'OTHER' ELSE {c} END AS {c}" for c in ROLES.categories)
    return f"""{USAGE},
e AS (SELECT enb, count(DISTINCT msisdn) AS subs FROM u WHERE enb IS NOT NULL GROUP BY enb),
tok AS (SELECT enb AS te, printf('A%04d', row_number() OVER (ORDER BY md5('42|' || enb), enb)) AS token FROM e WHERE subs >= {config.min_subscribers_area}),
bd AS (SELECT {bounds}, {caps} FROM u),
p AS (SELECT msisdn AS _subscriber, {bucket(width)} AS time_bucket, province, {folded},
      CASE WHEN enb IS NOT NULL THEN coalesce(token, coalesce(province, 'UNKNOWN') || '_OTHER') END AS area, {clipped}, {capped}
      FROM u LEFT JOIN tok ON enb = te, bd)"""


def cell_sql(source: str, extra: str = "") -> str:
    q = ", ".join(f"quantile_cont({c}, {v}) AS {c}_{n}" for c in METRICS for n, v in (("p10", 0.1), ("median", 0.5), ("p90", 0.9)))
    t = ", ".join(f"coalesce(sum({c}), 0) AS {c}_total" for c in VOLUMES)
    return f"SELECT {CELL}, count(DISTINCT _subscriber) AS n_subscribers{extra}, {q}, {t} FROM {source} GROUP BY ALL"


CELL_VALUES = [f"{c}_{n}" for c in METRICS for n in ("p10", "median", "p90")] + [f"{c}_total" for c in VOLUMES]


def suppressed(source: str, minimum: int, count: str = "n_subscribers", extra: str = "") -> str:
    """SELECT with pri and sec marks over `source`; `extra` partitions further."""
    part = f"{extra}time_bucket, province"
    return f"""SELECT *, {count} < {minimum} AS pri,
      (max(({count} < {minimum})::INT) OVER (PARTITION BY {part}) = 1 AND {count} >= {minimum}
       AND row_number() OVER (PARTITION BY {part}, {count} < {minimum} ORDER BY {count}, radio_access_type, application_category) = 1) AS sec
      FROM {source}"""
