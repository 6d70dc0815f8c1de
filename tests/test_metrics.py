"""Metric goldens taken from the original tests' inputs."""

import pytest

from weekcast.operators import metrics as me


def _frame(spark, y, p, h):
    return spark.createDataFrame(list(zip(y, p, h)), "weekly_sales double, predicted_sales double, is_holiday boolean")


def test_wmae_perfect(spark):
    df = _frame(spark, [1000.0, 2000.0], [1000.0, 2000.0], [False, True])
    assert me.wmae(df).collect()[0].wmae == 0


def test_wmae_equal_errors(spark):
    df = _frame(spark, [1000.0, 2000.0, 3000.0], [1100.0, 2100.0, 3100.0], [False, True, False])
    assert me.wmae(df).collect()[0].wmae == pytest.approx(100.0)


def test_wmae_weighted(spark):
    df = _frame(spark, [1000.0, 2000.0, 3000.0, 4000.0, 5000.0], [1100.0, 1900.0, 3200.0, 3800.0, 5100.0],
                [False, False, True, False, True])
    r = me.evaluate_model(df).collect()[0]
    assert r.wmae == pytest.approx(1900 / 13)
    assert r.mae == pytest.approx(140.0)


def test_mape_skips_zero_actuals(spark):
    df = _frame(spark, [0.0, 100.0], [10.0, 110.0], [False, False])
    assert me.evaluate_model(df).collect()[0].mape == pytest.approx(10.0)


def test_improvement(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(me.improvement_vs_baseline(F.lit(790.0)).alias("x")).collect()[0]
    assert r.x == pytest.approx((821 - 790) / 821 * 100)


def test_wmae_evaluator(spark):
    df = spark.createDataFrame([(1000.0, 1100.0, 0), (2000.0, 1900.0, 1)], "label double, prediction double, is_holiday int")
    ev = me.WMAEEvaluator()
    assert ev.evaluate(df) == pytest.approx(100.0)
    assert ev.isLargerBetter() is False
