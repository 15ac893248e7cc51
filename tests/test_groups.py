"""Groups and sweeps write keys and groups of rows, not whole rows or pairs."""

import pytest

from tests.test_plans import FOLDER, equal_sql
from veilframe.operators import release, transforms, utility
from veilframe.plans import queries as plans
from veilframe.plans.bindings import ROLES


@pytest.fixture
def written(monkeypatch):
    """(name, columns) of each table that is written."""
    tables = []
    for module in (release, transforms, plans):
        monkeypatch.setattr(module, "cut", lambda df, name="cut", real=module.cut: tables.append((name, df.columns)) or real(df, name))
    return tables


def test_the_grid_writes_rows_twice_and_no_metrics(spark, written):
    assert len(plans.anon_sweep_grid(spark, FOLDER).collect()) == 24
    rows = [columns for _, columns in written if ROLES.key in columns]
    assert len(rows) == 2  # 17 before: base, and the prepared rows and pairs of eight sweeps
    assert not [c for columns in rows for c in columns if "avg" in c or "sum" in c]


def test_k_anonymity_joins_rows_with_groups_that_have_k(spark, written):
    df = spark.createDataFrame([(str(k), 0, "A1" if k < 4 else f"B{k}", "EU" if k < 9 else None, "4G", "web") for k in range(12)] + [(None, 0, "C", "EU", "4G", None)] * 5, "_subscriber string, t long, area string, province string, radio_access_type string, application_category string").withColumnRenamed("t", "time_bucket")
    marked = release.mark_k(df, ROLES, 4).collect()
    assert len(marked) == 17
    assert sorted({(r.area, r._escalated, r._n, r._suppressed) for r in marked}) == [("A1", False, 4, False), ("EU", True, 0, True), ("EU", True, 5, False), ("UNKNOWN", True, 3, True)]
    assert [columns for name, columns in written if name == "whole"] == [[*ROLES.quasi, "_whole"]]


@pytest.mark.parametrize("name", ["anon_kanon", "anon_sweep_record"])
def test_the_same_groups_as_in_sql(spark, name):
    assert equal_sql(spark, name, "/root/testdata/sf0.01")


def test_fidelity_writes_counts_of_values_and_equals_its_sql(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(utility, "cut", lambda df, name="cut": tables.append(name))
    assert len(equal_sql(spark, "util_u5", "/root/testdata/sf0.01")) == 6
    assert not tables  # "tall" before: a row for each metric of each row of both sides


def test_fidelity_of_one_side_and_of_nothing(spark):
    raw = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "x double")
    row = utility.u5_fidelity(raw, raw.where("x > 5 or x is null"), ["x"]).first()
    assert (row.change_mean, row.change_p50, row.share_zero_raw, row.share_zero_rel, row.tail_flagged) == (None, None, 0.0, None, False)
    assert utility.u5_fidelity(raw.limit(0), raw.limit(0), ["x"]).count() == 0
    same = utility.u5_fidelity(raw, raw, ["x"]).first()
    assert (same.wasserstein, same.ks, same.change_p95) == (0.0, 0.0, 0.0)
