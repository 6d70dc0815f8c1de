"""Merged increments against the full aggregates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weekcast.operators import explore as ex
from weekcast.operators import rollups as ro

SCHEMA = "store_id int, dept_id int, feature_date date, weekly_sales decimal(18,2), is_holiday boolean"


def _rows(n, seed):
    rnd = random.Random(seed)
    from decimal import Decimal

    return [(rnd.choice([1, 2, 3, 40_000, 70_000, None]), rnd.choice([1, 5, 99_000, None]), dt.date(2020, 1, 6) + dt.timedelta(weeks=rnd.randrange(6)),
             Decimal(rnd.randrange(100_000)).scaleb(-2) if rnd.random() < 0.9 else None, rnd.random() < 0.2) for _ in range(n)]


def _same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    show = lambda df: sorted(map(str, df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]).collect()))
    assert show(a) == show(b)


def test_two_increments_equal_the_full_aggregates(spark, tmp_path):
    stores = spark.range(5)
    path = str(tmp_path / "state")
    rows = []
    for n, name in enumerate(("load", "one", "two")):
        more = _rows(200 if n == 0 else 40, n)
        rows += more
        for _ in range(2):  # delivered twice: counted once
            ro.append(spark.createDataFrame(more, SCHEMA), path, name)
        state, df = ro.Rollup(spark, path), spark.createDataFrame(rows, SCHEMA)
        _same(state.weekly_history(), ex.weekly_history(df))
        _same(state.explorer_summary(), ex.explorer_summary(df))
        _same(state.sales_over_time(), ex.sales_over_time(df))
        _same(state.sales_by_store_week(), ex.sales_by_store_week(df))
        _same(state.store_coverage(stores), ex.store_coverage(df, stores))
    merged = str(tmp_path / "merged")
    ro.compact(spark, path, merged)
    _same(ro.Rollup(spark, merged).weekly_history(), ex.weekly_history(df))


def test_an_empty_increment_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    empty = spark.createDataFrame([], SCHEMA)
    ro.append(empty, path, "none")
    _same(ro.Rollup(spark, path).explorer_summary(), ex.explorer_summary(empty))
    df = spark.createDataFrame(_rows(30, 9), SCHEMA)
    ro.append(df, path, "some")
    _same(ro.Rollup(spark, path).weekly_history(), ex.weekly_history(df))
    assert ro.Rollup(spark, path).totals.agg(F.sum("n_rows")).first()[0] == pytest.approx(30)
