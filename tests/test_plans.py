import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.operators import reports
from veilframe.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


def equal_sql(spark, name, folder=FOLDER):
    """The rows of a query, which must be those of its SQL."""
    base = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = base.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    df = plans.QUERIES[name](spark, folder)
    rows = df.select(*names).collect()
    assert sorted(str(tuple(r)) for r in rows) == want
    return rows


def test_the_registry_has_tokens_of_all_documents(spark):
    docs = plans.read(spark, FOLDER, "documents")
    odd = docs.where("doc_id % 2 = 1 and text rlike '(^|[^A-Za-z0-9])[0-9]{8,}([^A-Za-z0-9]|$)'")
    clean = plans.guard_scrub(spark, FOLDER).join(odd.select("doc_id"), "doc_id", "left_semi")
    assert odd.count() and clean.where("text rlike '[0-9]{8,}'").isEmpty()
    for name in ("guard_scan_text", "guard_scan_table", "guard_scrub", "guard_scrub_counts"):
        assert equal_sql(spark, name)


def test_sweeps_cover_the_grid(spark):
    rows = equal_sql(spark, "anon_sweep_grid")
    assert len({(r.time_bucket_days, r.area_mode, r.k) for r in rows}) == len(rows) == 24


def test_attacks_use_the_whole_samples(spark):
    larger = "/root/testdata/sf0.01"
    for name in ("risk_r2", "risk_r2_date", "risk_a2_province"):
        for row in equal_sql(spark, name, larger):
            assert row.n_sampled == min(1000, row.n_eligible)
    equal_sql(spark, "risk_a6")


def test_headline_has_seven_figures(spark):
    """No cell of the smallest tables is published: that figure is null, the row stays."""
    (row,) = equal_sql(spark, "headline")
    assert len(row) == 7 and [c for c, v in row.asDict().items() if v is None] == ["u1_headline_pct"]


def test_story_has_the_figures_of_its_sections(spark):
    (row,) = equal_sql(spark, "story_export")
    payload = json.loads(row.payload)
    assert [a["id"] for a in payload["attacks"]] == ["A1", "A2", "A3", "A4", "A5", "A6"]
    assert payload["cells"]["cells_out"] > 0 and payload["windows"] == sorted(payload["windows"])
    assert sum(x["share"] for x in payload["province_shares"]) == pytest.approx(100, abs=1e-3)


def test_a_story_without_rows_keeps_all_members(spark):
    cells = spark.createDataFrame([], "province string, n_subscribers long")
    row = reports.story({"shares": reports.shares(cells, "province"), "list": reports.listed(cells, [F.col("province")], "list"), "none": cells.select("province"), "both": cells}).first()
    assert json.loads(row.payload) == {"shares": [], "list": [], "none": None, "both": None}


def test_shares_are_ordered_and_ties_go_by_value(spark):
    cells = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), (None, 0)], "province string, n_subscribers long")
    row = reports.shares(cells, "province").first()
    assert [(x.value, x.share) for x in row.shares] == [("c", 50.0), ("a", 25.0), ("b", 25.0), (None, 0.0)]
