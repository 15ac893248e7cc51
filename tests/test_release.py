from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilframe.functions import numeric as N
from veilframe.functions.keyed import hmac_sha256
from veilframe.operators import release, risk, transforms
from veilframe.operators.roles import Roles
from veilframe.operators.transforms import ReleaseConfig

ROLES = Roles()
START = datetime(2027, 4, 30, 16)
COLUMNS = "time_start timestamp, msisdn string, imsi string, imei string, tac string, enb string, province string, radio_access_type string, application_category string, tp_dl_avg double, cont_rtt_radio_avg double, http_response_time_avg double, data_GB_sum double, im_video_GB_sum double, im_audio_GB_sum double, tethering_data_GB_dl_sum double"
CONFIG = ReleaseConfig(k=3, bucket_minutes=15, min_subscribers_area=3, min_subscribers_category=3, min_subscribers_cell=3, epsilon=None)


def row(when, who, enb, province, radio, app, *metrics):
    return (when, f"3584{who:08d}", f"244{who:09d}", f"356938{who:09d}", f"356938{who:02d}", enb, province, radio, app, *map(float, metrics))


def usage_rows():
    rows = [row(START + timedelta(minutes=10 * r), s, "100000000001", "Uusimaa" if s % 2 else "Pirkanmaa", "5G", "Streaming", 10 + s, 20 + s, 30 + s, 0.5 + 0.1 * s, 0.1, 0.05, 0) for s in range(12) for r in range(4)]
    return rows + [row(START, 99, "100000000099", "Lappi", "3G", "Gaming", 50, 400, 900, 99, 9, 9, 5)]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(usage_rows(), COLUMNS).cache()


@pytest.fixture(scope="module")
def prepared(raw):
    return transforms.prepare(raw, ROLES, CONFIG).cache()


def test_prepare(prepared):
    assert not set(ROLES.identifiers) & set(prepared.columns)
    assert prepared.where("area = 'Lappi_OTHER'").count() == 1
    assert prepared.agg(F.max("data_GB_sum")).first()[0] < 99
    assert {r[0] for r in prepared.select("radio_access_type").distinct().collect()} == {"5G", "OTHER"}


def test_cells_alone_are_prepared_as_with_the_rest(spark, raw):
    """Rare categories, null keys, regions and times included."""
    odd = [(None, *row(START, 98, "100000000001", "Uusimaa", "5G", "Gaming", *range(7))[1:]), row(START, 97, "100000000001", None, None, "Streaming", *range(7))]
    log = raw.union(spark.createDataFrame(odd, COLUMNS)).union(raw.limit(1).withColumn("msisdn", F.lit(None).cast("string")))
    whole = transforms.prepare(log, ROLES, CONFIG).select(ROLES.key, *ROLES.cell)
    alone = transforms.prepare_cells(log, ROLES, CONFIG)
    assert sorted(map(str, alone.collect())) == sorted(map(str, whole.collect()))
    assert alone.where("application_category = 'OTHER'").count() == 2 and alone.where("time_bucket IS NULL").count() == 1


def test_bucket_is_not_finer_than_the_data(raw):
    assert tuple(transforms.effective_bucket(raw, "time_start", 5).first()) == (10, 10)
    assert tuple(transforms.effective_bucket(raw, "time_start", None).first()) == (10, 10)
    assert transforms.native_gap(raw.limit(1), "time_start").first()[0] == 1


def test_k_counts_subscribers(spark, prepared):
    one = prepared.limit(1).withColumns({"_subscriber": F.lit("x"), "area": F.lit("z"), "province": F.lit("z")})
    marked = release.mark_k(prepared.union(one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("i").select(*prepared.columns)), ROLES, 3)
    assert marked.where("_subscriber = 'x'").where("_suppressed").count() == 10
    kept = release.k_anonymise(prepared, ROLES, 3)
    assert kept.groupBy(*ROLES.quasi).agg(F.countDistinct("_subscriber").alias("n")).where("n < 3").isEmpty()


def test_null_groups(spark, prepared):
    nulls = prepared.withColumn("_subscriber", F.lit(None).cast("string"))
    assert release.k_anonymise(nulls, ROLES, 1).isEmpty()
    assert release.k_anonymise(prepared.withColumn("province", F.lit(None).cast("string")), ROLES, 3).count() > 0
    assert release.k_anonymise(prepared.limit(0), ROLES, 3).isEmpty()


def test_session_labels(prepared):
    out = release.session_release(prepared, ROLES, CONFIG, b"key")
    assert "_subscriber" not in out.columns
    assert out.where(~F.col("session_id").rlike("^[0-9a-f]{8}-[0-9a-f]{8}$")).isEmpty()
    release.assert_k(out, ROLES, 3)


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        got = spark.range(3).select(hmac_sha256(key, F.col("id").cast("string")).alias("h")).collect()
        assert [r.h for r in got] == [hmac.new(key, str(i).encode(), hashlib.sha256).hexdigest() for i in range(3)]


def test_secondary_suppression(spark):
    rows = [("Thin", 1), ("Medium", 5), ("Large", 10)]
    cells = spark.createDataFrame([(START, "p", r, "a", n) for r, n in rows], "time_bucket timestamp, province string, radio_access_type string, application_category string, n_subscribers long")
    marked = release.mark_suppressed(cells, ROLES, 4)
    kept = marked.where("not _primary and not _secondary").collect()
    assert [r.radio_access_type for r in kept] == ["Large"]


@pytest.mark.parametrize("secondary, expected", [(False, (1, 1, 1)), (True, (2, 0, 0))])
def test_differencing(spark, secondary, expected):
    cells = spark.createDataFrame([(START, "p", f"r{n}", "a", n, n) for n in (40, 25, 12, 6)], "time_bucket timestamp, province string, radio_access_type string, application_category string, true_count long, published long")
    got = risk.differencing(release.mark_suppressed(cells, ROLES, 10, secondary, "published"), ROLES, 2).first()
    assert (got.suppressed_cells, got.lone_slices, got.recovered) == expected


def test_contribution_bound(spark):
    rows = [(f"s{s}", START + timedelta(hours=c), "p", "r", "a") for s in range(20) for c in range(6)]
    df = spark.createDataFrame(rows, "_subscriber string, time_bucket timestamp, province string, radio_access_type string, application_category string")
    assert release.contribution_bound(df, ROLES).first()[0] == 6
    assert release.clip_contributions(df, ROLES, 2, "s").count() == 40


def test_noise_does_not_depend_on_partitions(prepared):
    config = ReleaseConfig(**{**CONFIG.__dict__, "epsilon": 0.5, "min_subscribers_cell": 1})
    one = release.marked_cells(prepared.repartition(1), ROLES, config).select("n_subscribers", *ROLES.cell)
    two = release.marked_cells(prepared.repartition(7), ROLES, config).select("n_subscribers", *ROLES.cell)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_safe_release(spark, raw, prepared):
    with pytest.raises(release.LeakError):
        release.assert_safe(prepared, ROLES, "record")
    with pytest.raises(release.LeakError):
        release.assert_safe(prepared.drop("_subscriber").withColumn("area", F.lit("100000000001")), ROLES, "record", raw)
    release.assert_safe(release.record_release(prepared, ROLES, CONFIG), ROLES, "record", raw)


def test_significant_figures(spark):
    values = [(0.0, 0.0), (123456.0, 123000.0), (0.000123456, 0.000123), (1.125, 1.12), (2.345, 2.35), (12450.0, 12400.0), (None, None), (float("inf"), float("inf"))]
    got = spark.createDataFrame(values, "x double, y double").select(N.significant(F.col("x"), 3).alias("z"), "y").collect()
    assert [r.z for r in got] == [r.y for r in got]


def test_configuration_is_checked():
    for wrong in ({"area_mode": "x"}, {"epsilon": 0.0}, {"k": 0}):
        with pytest.raises(ValueError):
            ReleaseConfig(**wrong)


def test_metric_columns_by_name(raw):
    assert ROLES.qualities(raw) == ["tp_dl_avg", "cont_rtt_radio_avg", "http_response_time_avg"]
    assert ROLES.volumes(raw) == ["data_GB_sum", "im_video_GB_sum", "im_audio_GB_sum", "tethering_data_GB_dl_sum"]
