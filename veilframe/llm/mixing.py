"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import cut, free_name

#: Bits of the hash that one histogram resolves, and bits of the hash.
BITS, HASH_BITS = 8, 56
#: Most times that one document may be taken.
REPEATS = 3
#: Sources whose table may be broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(ident: str) -> Column:
    """HASH_BITS bits of the id's MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.col(ident).cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, copies, budget) from rows of (source, size).

    Weights are 1, 2, 3, repeating, over the sources by code point, null last. A
    target is min(repeats * size, level * weight) with one level for all, so that
    the targets sum to the corpus; that is where capping and resharing ends.
    The windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1)
    ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("ratio", F.lit(float(repeats)) * F.col("source_size") / F.col("weight"))
    by = by.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.sum("weight").over(Window.partitionBy()).alias("weights"),
        F.coalesce(F.sum(F.lit(repeats) * F.col("source_size")).over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("capped_weight"),
    )
    level = (F.col("total") - F.col("capped")).cast("double") / (F.col("weights") - F.col("capped_weight")).cast("double")
    by = by.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    by = by.withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "source", "level"))).over(Window.partitionBy())["level"])
    target = F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("source_size") * float(repeats))
    by = by.withColumn("target", target)
    copies = F.least(F.lit(repeats), F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))).cast("int")
    return by.withColumn("copies", copies).select(
        "source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget")
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def mix_sources(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", repeats: int = REPEATS) -> DataFrame:
    """How many words of each document the mix takes.

    Returns (doc_id, size, source_size, target, taken, copies), one row per row of
    `docs`. Every document is taken `copies` whole times: floor(target / size of
    the source) times, and once more where its hash lies below its source's
    threshold. Thresholds come from nested histograms: words by source and the
    next BITS bits of the hash; only the bucket in which a source's budget ends
    is resolved further, until one hash value is left in it. That value's
    documents are taken if this brings the sum nearer to the target. No rows are
    sorted, and reruns agree.

    Null text counts no words; a null source is a source of its own (last in
    order); a source without words has target 0. Repeated rows and ids are
    treated alike: rows with one id share a hash and are taken together. Other
    columns are ignored, so their names cannot clash. An empty table gives an
    empty result.
    """
    base = docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    base = cut(base.withColumn("h", F.coalesce(unit_hash("doc_id"), F.lit(0))), "sizes")
    goal = cut(source_targets(base, repeats), "targets")
    n = goal.count()
    state = goal.where("source_size > 0 and budget > 0").select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used"))
    inside, bits = base.where("size > 0"), 0
    while True:
        bits += BITS
        left = HASH_BITS - bits
        by_source = _small(state.withColumnRenamed("source", "_s"), n)
        near = inside.join(by_source, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", left + BITS) == F.col("prefix")))
        bucket = F.shiftright("h", left)
        if bits > BITS:  # few rows are left; later rounds read only them
            near = cut(near.select("source", "size", "h", "prefix", "used", "budget"), "boundary")
        hist = near.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("used").alias("used"), F.first("budget").alias("budget")
        )
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("used") + F.sum("words").over(run))
        hit = F.min(F.when(F.col("upto") >= F.col("budget"), F.struct("bucket", "upto", "words", "low", "high")))
        state = cut(
            hist.groupBy("source").agg(hit.alias("x"), F.first("budget").alias("budget")).where("x is not null").select(
                "source", "budget", F.col("x.bucket").alias("prefix"), (F.col("x.upto") - F.col("x.words")).alias("used"),
                F.col("x.upto").alias("upto"), F.col("x.low").alias("low"), F.col("x.high").alias("high"),
            ),
            "state",
        )
        if left == 0 or state.where("low < high").isEmpty():
            break
        inside = near.select("source", "size", "h") if bits > BITS else inside
        state = state.drop("upto", "low", "high")
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("used")
    limit = state.select("source", F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("below"))
    goal = goal.join(limit.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # a budget that no bucket reaches (rounding) takes the whole source once more
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target", "copies", F.coalesce("below", F.when((F.col("budget") > 0) & (F.col("source_size") > 0), F.lit(2**HASH_BITS)), F.lit(-1)).alias("below"))
    out = base.join(_small(goal, n), F.col("source").eqNullSafe(F.col("_s")))
    times = F.least(F.lit(repeats), F.col("copies") + (F.col("h") < F.col("below")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("copies"))


def take_mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", repeats: int = REPEATS) -> DataFrame:
    """`docs` with each row as often as the mix takes it (see `mix_sources`).

    Decisions are by id: rows with one id are alike, null ids too. Documents without
    words are taken `copies` times like others of their source. Columns stay as they
    are, whatever their names. An empty table stays empty.
    """
    by, times, turn = (free_name(docs, x) for x in ("_mix_id", "_mix_n", "_mix_k"))
    ids = mix_sources(docs, ident, text, source, repeats).select(F.col("doc_id").alias(by), F.col("copies").alias(times)).dropDuplicates([by])
    joined = docs.join(ids, docs[ident].eqNullSafe(F.col(by)))
    repeated = joined.where(F.col(times) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.drop(by, times, turn)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 14))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(3 * source_size) OVER p, 0) AS capped, coalesce(sum(weight) OVER p, 0) AS capped_weight
      FROM r WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped)::DOUBLE / (weights - capped_weight)::DOUBLE AS level FROM c),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, l.source_size,
             CASE WHEN l.level <= l.ratio THEN f.level * weight ELSE source_size * 3.0::DOUBLE END AS target
      FROM l, f),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size::DOUBLE)) END::BIGINT AS copies FROM t),
v AS (SELECT source, h, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY source, h),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM v),
b AS (SELECT u.source, u.h, (u.upto - u.words) AS used, u.upto, g.target - g.copies * g.source_size AS budget
      FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source),
e AS (SELECT source, h, (used < budget AND (upto < budget OR upto - budget < budget - used)) AS extra FROM b)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * least(3, g.copies + coalesce(e.extra, false)::INT))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.h = d.h
"""
