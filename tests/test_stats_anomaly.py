"""Exact quantiles against numpy (with one hot group), anomalies, forecasts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.operators import anomaly as an
from weekcast.operators import forecast as fo
from weekcast.operators import stats
from weekcast.operators.stats import exact_quantiles


def test_exact_quantiles_hot_group(spark):
    rnd = random.Random(7)
    rows = [(0 if rnd.random() < 0.4 else rnd.randint(1, 5), rnd.gauss(0, 10)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r for r in exact_quantiles(df, "x", [0.25, 0.5, 0.75], by=["g"]).collect()}
    for g in range(6):
        xs = np.array([x for k, x in rows if k == g])
        for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert getattr(got[g], name) == pytest.approx(np.quantile(xs, q), abs=1e-9)


def test_exact_quantiles_global(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 2, 4]], "x double")
    r = exact_quantiles(df, "x", [0.5, 0.1]).collect()[0]
    assert r.q50 == 3 and r.q10 == pytest.approx(1.4)


def test_slices_hold_alike_however_values_lie(spark):
    """Heavy tails and one outlier in a hot group: no slice has more than twice the mean of its distinct values."""
    rnd = random.Random(9)
    rows = [(None if i % 3 else 1, rnd.lognormvariate(8, 2)) for i in range(60_000)] + [(None, 1e12), (1, -1e12), (2, 7.0), (2, 7.0), (2, 9.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    counts = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    sizes = stats.sliced_values(counts, "x", "c", ["g"]).groupBy("g", "_s").agg(F.count(F.lit(1)).alias("n")).collect()
    for g in (None, 1):
        mine = [r.n for r in sizes if r.g == g]
        assert len(mine) > 0.9 * stats.SLICES and max(mine) <= 2 * sum(mine) / len(mine)
    assert [r.n for r in sizes if r.g == 2] == [2]
    got = {r.g: r for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.999, 1.0], by=["g"], names=["a", "b", "c", "d", "e"]).collect()}
    for g in (None, 1, 2):
        xs = np.array([x for k, x in rows if k == g])
        assert [got[g].a, got[g].b, got[g].c, got[g].d, got[g].e] == pytest.approx(np.quantile(xs, [0, 0.25, 0.5, 0.999, 1]), rel=1e-12)


def test_quantiles_of_ties_over_many_slices(spark):
    df = spark.range(20_000).selectExpr("CAST(id % 5000 AS DOUBLE) AS x")
    r = exact_quantiles(df, "x", [0.1, 0.5, 0.75]).first()
    assert (r.q10, r.q50, r.q75) == pytest.approx(tuple(np.quantile(np.arange(20_000) % 5000, [0.1, 0.5, 0.75])))
    assert exact_quantiles(df.limit(0), "x", [0.5]).first().q50 is None


def test_anomalies_planted(spark):
    rnd = random.Random(42)
    rows = [(1, 1, dt.date(2023, 1, 6) + dt.timedelta(weeks=i), rnd.uniform(5000, 50000)) for i in range(198)]
    rows += [(1, 1, dt.date(2027, 1, 1), 200000.0), (1, 1, dt.date(2027, 1, 8), 250000.0)]
    df = spark.createDataFrame(rows, "store_id int, dept_id int, feature_date date, weekly_sales double")
    a = an.zscore_anomalies(df, 3.0)
    assert a.count() >= 2
    top = an.anomaly_top(a, 20).collect()
    assert top[0].feature_date == dt.date(2027, 1, 8)


def test_constant_series_flags_nothing(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "weekly_sales double")
    assert an.zscore_anomalies(df).count() == 0


def test_forecast_grid_and_interval(spark):
    rows = [(1, 1, dt.date(2024, 1, 5), 1000.0), (1, 2, dt.date(2023, 12, 29), 10.0)]
    eng = spark.createDataFrame(rows, "store_id int, dept_id int, feature_date date, weekly_sales double")
    fc = fo.generate_forecasts(eng).orderBy("dept_id", "forecast_date").collect()
    assert len(fc) == 16
    # every series starts after the global last date
    assert fc[0].forecast_date == dt.date(2024, 1, 12) and fc[8].forecast_date == dt.date(2024, 1, 12)
    assert float(fc[0].predicted_sales) == 1050.0
    assert float(fc[0].prediction_upper) == pytest.approx(1050 + 1.96 * 157.5, abs=0.01)
    assert float(fc[8].prediction_lower) == 0.0  # min std 100 pushes the bound below 0
    assert [float(r.confidence_score) for r in fc[:3]] == [0.85, 0.83, 0.81]


def test_exact_quantiles_against_numpy_with_ties_nulls_and_outliers(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([None, 0, 1, 2]), rnd.choice([7.0, 7.0, rnd.gauss(0, 5), 1e12, None])) for _ in range(2000)] + [(9, 3.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], by=["g"]).collect()}
    assert set(got) == {None, 0, 1, 2, 9}
    for g, r in got.items():
        xs = np.array([x for k, x in rows if k == g and x is not None])
        for name, q in (("q00", 0.0), ("q25", 0.25), ("q50", 0.5), ("q90", 0.9), ("q100", 1.0)):
            assert getattr(r, name) == pytest.approx(np.quantile(xs, q), rel=1e-9, abs=1e-9)
    empty = exact_quantiles(df.limit(0), "x", [0.5]).collect()
    assert len(empty) == 1 and empty[0].q50 is None


def test_equal_values_do_not_meet_as_rows(spark):
    """A value that every row has is one counted row after the map-side aggregation."""
    df = spark.range(0, 50_000, 1, 8).selectExpr("1 AS g", "5.0D AS x")
    plan = exact_quantiles(df, "x", [0.5], by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert exact_quantiles(df, "x", [0.5], by=["g"]).first().q50 == 5.0
