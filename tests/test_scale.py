"""Work that must not grow faster than the rows, and sums whose last digits must not count."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import numeric
from veilframe.operators import ordered, release, risk, transforms, utility
from veilframe.operators.roles import Roles
from veilframe.plans import queries as plans
from veilframe.plans.bindings import SMALL, usage

ROLES = Roles()


def work(spark, run):
    """(rows read, rows shuffled) of all stages of a run."""
    def stages():
        gateway = spark.sparkContext._gateway
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): (s.inputRecords(), s.shuffleWriteRecords()) for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    before = stages()
    run()
    new = [v for k, v in stages().items() if k not in before]
    return tuple(map(sum, zip(*new, strict=True)))


def test_targets_that_share_their_points_are_one_set(spark, tmp_path):
    """400 subscribers in the same four places: 1.6 million candidate rows if each target had its own."""
    spark.range(1600).select((F.col("id") % 400).cast("string").alias("who"), F.floor(F.col("id") / 400).alias("at")).write.parquet(str(tmp_path / "p"))
    rows = []
    _, moved = work(spark, lambda: rows.extend(risk.trajectories(spark.read.parquet(str(tmp_path / "p")), "who", [F.col("at")], sample=400).orderBy("p").collect()))
    assert [(r.p, r.n_sampled, r.median_all_points, r.pct_unique) for r in rows] == [(p, 400, 400.0, 0.0) for p in (1, 2, 3, 4)]
    assert moved < 40_000


def test_quantiles_read_the_rows_twice(spark, tmp_path):
    n = 300_000
    spark.range(n).select(F.exp(F.rand(1) * 40 - 20).alias("v")).write.parquet(str(tmp_path / "v"))
    read, _ = work(spark, lambda: ordered.quantiles(spark.read.parquet(str(tmp_path / "v")), [], "v", [0.01, 0.5, 0.99]).collect())
    assert read < 2.5 * n


def test_quantiles_of_columns_look_again_at_few_rows(spark, monkeypatch):
    n, looked, quantiles = 100_000, [], ordered.quantiles

    def spied(df, by, value, shares, only, near):
        return quantiles(df, by, value, shares, only, lambda ranges: [looked.append(near(ranges).count()), near(ranges)][1])

    monkeypatch.setattr(ordered, "quantiles", spied)
    v, w = F.exp(F.rand(1) * 40 - 20), F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 11 > 0, (F.col("id") % 5).cast("double"))
    rows = spark.range(n).select(v.alias("v"), w.alias("w")).cache()
    got = ordered.column_quantiles(rows, {"v": (F.col("v"), [0.01, 0.99]), "w": (numeric.clean(F.col("w")), [0.5])})
    want = rows.agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("v"), F.percentile(numeric.clean(F.col("w")), 0.5).alias("w")).first()
    assert got["v"] == pytest.approx(want.v, rel=1e-12) and got["w"] == [want.w]
    assert len(looked) == 1 and 0 < looked[0] < n / 50


def test_quantiles_of_infinities_and_tiny_values(spark):
    values = [float("-inf"), -1e300, -5e-324, -0.0, 0.0, 5e-324, 1e-310, 1e300, float("inf")]
    got = ordered.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", [k / 8 for k in range(9)]).first()
    assert list(got.at) == values


def test_quantiles_of_cells_keep_no_buffer_for_each_subscriber(spark):
    rows = spark.createDataFrame([(str(k), 0, "EU", "4G", "web", float(k), 0.5) for k in range(9)], "_subscriber string, t long, province string, radio_access_type string, application_category string, tp_dl_avg double, data_GB_sum double")
    cells = release.cells(rows.withColumn("time_bucket", F.timestamp_seconds("t")).drop("t"), ROLES, True)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "percentile(" in line and "count(" in line]
    (row,) = cells.collect()
    assert (row.n_subscribers, row.n_rows, row.tp_dl_avg_p10, row.tp_dl_avg_median, row.data_GB_sum_total) == (9, 9, 0.8, 4.0, 4.5)


@pytest.mark.parametrize("total", [11.65, 11.650000000000002, 11.649999999999999])
def test_published_totals_do_not_depend_on_the_order_of_a_sum(spark, total):
    marked = spark.createDataFrame([(1, 1, total, False, False)], "n_subscribers long, true_count long, x_total double, _primary boolean, _secondary boolean")
    assert release.publish_cells(marked, 3).first().x_total == 11.6


def test_regions_whose_means_differ_in_the_last_digit_tie(spark):
    rows = [("a", 0.1 + 0.2, 1.0), ("b", 0.3, 1.0), ("c", 0.5, 2.0)]
    joined = spark.createDataFrame([(r, x, 1, y, 1) for r, x, y in rows], "province string, m_median_rel double, n_subscribers_rel long, m_median_raw double, n_subscribers_raw long")
    assert utility.u3_ranks(joined, ROLES, ["m"]).first().spearman == 1.0


@pytest.mark.parametrize(("name", "times"), [("anon_laplace", 6), ("risk_a6", 8)])
def test_who_is_in_which_cell_is_found_without_places_and_metrics(spark, name, times):
    """Both read 10 rows for each line when the whole table was prepared for them."""
    folder = "/root/testdata/sf0.01"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    read, _ = work(spark, lambda: plans.QUERIES[name](spark, folder).collect())
    assert read < times * lines


def test_categories_are_folded_by_a_table_of_their_own(spark):
    """Counts of places, of which there are many, do not stand in the table that rows are
    joined to for their categories: it would look too large to be broadcast."""
    source = transforms.read_source(usage(spark, "/root/testdata/sf0.001"), ROLES, SMALL)
    assert {r["column"] for r in source.counts.collect()} == set(ROLES.categories)
