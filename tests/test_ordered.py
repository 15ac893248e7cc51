"""Quantiles and running totals against plain arithmetic."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import ordered

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("held", [4, 10_000])
def test_quantiles_of_any_shape(spark, monkeypatch, held):
    monkeypatch.setattr(ordered, "HELD", held)
    rnd = np.random.default_rng(2)
    groups = {
        "normal": rnd.standard_normal(3000), "heavy": np.exp(20 * rnd.standard_normal(2000)), "few": rnd.integers(0, 4, 3000).astype(float), "two": np.array([0.0] * 500 + [1.0] * 500),
        "one": np.array([7.5]), "pair": np.array([1.0, 2.0]), "same": np.full(900, -3.0), "spike": np.concatenate([np.full(1500, 5.0), rnd.standard_normal(1500)]), "none": np.array([]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(None, 1.0), (None, 3.0), ("none", None), ("few", None)]
    random.Random(1).shuffle(rows)
    got = {r.g: r for r in ordered.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", SHARES).collect()}
    assert "none" not in got and got[None].at[3] == 2.0
    for g, values in groups.items():
        if len(values):
            assert got[g].n == len(values)
            np.testing.assert_allclose(got[g].at, np.quantile(values, SHARES), rtol=1e-12, atol=1e-12)


def test_whole_columns_and_empty_ones(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    assert ordered.column_quantiles(df, {"a": (F.col("a"), [0.5, 0.9995]), "b": (F.col("b"), [0.5]), "c": (-F.col("a"), [0.9995])}) == {"a": [500.0, 999.5], "b": [None], "c": [-0.5]}
    assert ordered.quantiles(df.where("a < 0"), [], "a", [0.5]).collect() == []


def test_a_million_distinct_values_in_bounded_buffers(spark, monkeypatch):
    """No buffer holds more than HELD values, whatever the number of rows."""
    monkeypatch.setattr(ordered, "HELD", 5000)
    n = 1_000_003
    df = spark.range(n).select(((F.col("id") * 777_767) % n).cast("double").alias("v"))
    seen = []
    narrow = ordered._narrow

    def watched(rows, by, state):
        seen.extend(r[0] for r in state.where("held").select(F.col("b") - F.col("a") + 1).collect())
        return narrow(rows, by, state)

    monkeypatch.setattr(ordered, "_narrow", watched)
    assert ordered.quantiles(df, [], "v", [0.01, 0.5, 0.99]).first().at == pytest.approx([x * (n - 1) for x in (0.01, 0.5, 0.99)])
    assert 0 < max(seen) <= 5000


def test_running_totals(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), v, rnd.randrange(5), rnd.randrange(3)) for v in rnd.sample(range(10_000), 400)]
    got = ordered.running(spark.createDataFrame(rows, "g string, v long, x long, y long"), ["g"], ["v"], ["x", "y"])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    got = {(r.g, r.v): r for r in got.collect()}
    for g in ("a", "b", None):
        own = sorted(r for r in rows if r[0] == g)
        for k, (_, v, *_) in enumerate(own):
            r = got[g, v]
            assert (r.run_x, r.run_y) == (sum(o[2] for o in own[: k + 1]), sum(o[3] for o in own[: k + 1]))
            assert (r.all_x, r.next) == (sum(o[2] for o in own), own[k + 1][1] if k + 1 < len(own) else None)
