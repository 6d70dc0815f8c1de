"""Unit tests of the feature operators on small frames (properties of the original tests)."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekcast.operators import features as fe


def _sales(spark, stores=2, depts=2, weeks=52, seed=42, gaps=False):
    rnd = random.Random(seed)
    rows = []
    start = dt.date(2023, 1, 6)
    for s in range(1, stores + 1):
        for d in range(1, depts + 1):
            for w in range(weeks):
                if gaps and rnd.random() < 0.1:
                    continue
                rows.append((s, d, start + dt.timedelta(weeks=w), round(rnd.uniform(5000, 50000), 2),
                             rnd.random() < 0.1))
    return spark.createDataFrame(rows, "store_id int, dept_id int, date date, weekly_sales double, is_holiday boolean")


def _features(spark, stores=2, weeks=52, seed=42, drop_every=0):
    rnd = random.Random(seed)
    rows = []
    start = dt.date(2023, 1, 6)
    for s in range(1, stores + 1):
        for w in range(weeks):
            if drop_every and w % drop_every == 0:
                continue
            md = [rnd.choice([None, 0.0, 100.0, 2500.0]) for _ in range(5)]
            rows.append((s, start + dt.timedelta(weeks=w), rnd.uniform(30, 100), rnd.uniform(2.5, 4.5), *md,
                         rnd.uniform(200, 250), rnd.uniform(4, 10), False))
    return spark.createDataFrame(rows, "store_id int, date date, temperature double, fuel_price double, "
                                       "markdown1 double, markdown2 double, markdown3 double, markdown4 double, "
                                       "markdown5 double, cpi double, unemployment double, is_holiday boolean")


def _stores(spark):
    return spark.createDataFrame([(1, "A", 150000), (2, "B", 100000)], "store_id int, store_type string, size int")


def test_temporal(spark):
    df = spark.createDataFrame([(dt.date(2012, 2, 1),), (dt.date(2012, 2, 29),), (dt.date(2012, 12, 31),)], "date date")
    r = fe.temporal_features(df).orderBy("date").collect()
    assert [x.week_of_year for x in r] == [5, 9, 1]  # ISO weeks
    assert [x.quarter for x in r] == [1, 1, 4]
    assert [x.is_month_start for x in r] == [True, False, False]
    assert [x.is_month_end for x in r] == [False, True, True]


def test_lags_first_rows_null(spark):
    out = fe.lag_features(_sales(spark)).toPandas().sort_values(["store_id", "dept_id", "date"])
    for _, g in out.groupby(["store_id", "dept_id"]):
        assert g["sales_lag_1"].isna().sum() == 1
        assert g["sales_lag_4"].isna().sum() == 4
        assert list(g["sales_lag_1"].iloc[1:]) == list(g["weekly_sales"].iloc[:-1])


def test_rolling_matches_pandas(spark):
    sales = _sales(spark, gaps=True)
    got = fe.rolling_features(sales).toPandas().sort_values(["store_id", "dept_id", "date"])
    pdf = sales.toPandas().sort_values(["store_id", "dept_id", "date"])
    for n in (4, 13, 52):
        g = pdf.groupby(["store_id", "dept_id"])["weekly_sales"]
        exp_mean = g.transform(lambda x: x.rolling(n, min_periods=1).mean())
        exp_std = g.transform(lambda x: x.rolling(n, min_periods=1).std())
        assert (got[f"rolling_mean_{n}"].values - exp_mean.values).__abs__().max() < 1e-6
        diff = (got[f"rolling_std_{n}"] - exp_std.values).abs()
        assert diff.max() < 1e-6 or diff.isna().sum() == exp_std.isna().sum()
    assert (got["rolling_min_4"] <= got["rolling_mean_4"] + 1e-9).all()
    assert (got["rolling_mean_4"] <= got["rolling_max_4"] + 1e-9).all()


def test_rolling_closed_left_excludes_current(spark):
    got = fe.rolling_features(_sales(spark, stores=1, depts=1), windows=[4], closed="left").orderBy("date").collect()
    assert got[0].rolling_mean_4 is None
    assert got[1].rolling_mean_4 == pytest.approx(got[0].weekly_sales)


def test_economic_matches_sorted_diff(spark):
    sales = _sales(spark, gaps=True)
    joined = fe.sales_features_join(sales, _features(spark, drop_every=7))
    got = fe.economic_features(joined).toPandas().sort_values(["store_id", "date", "dept_id"])
    pdf = joined.toPandas().sort_values(["store_id", "date", "dept_id"], kind="mergesort")
    for c in ("fuel_price", "cpi", "unemployment"):
        exp = pdf.groupby("store_id")[c].diff()
        a, b = got[f"{c}_change"].values, exp.values
        assert ((pd.isna(a) & pd.isna(b)) | (abs(a - b) < 1e-9)).all(), c
    dev = got.groupby("store_id")["temperature_deviation"].mean()
    assert dev.abs().max() < 1e-6  # centred per store


def test_markdown(spark):
    df = spark.createDataFrame([(None, 0.0, 5.0, -1.0, None)], ", ".join(f"markdown{k} double" for k in range(1, 6)))
    r = fe.markdown_features(df).collect()[0]
    assert r.markdown1 == 0 and r.total_markdown == 4.0 and r.has_markdown == 1 and r.markdown_count == 1


def test_store_features_one_hot_and_size(spark):
    sales = _sales(spark, stores=3)
    out = fe.store_features(sales, _stores(spark)).toPandas()
    s3 = out[out.store_id == 3]
    assert (s3[["store_type_a", "store_type_b", "store_type_c"]].sum(axis=1) == 0).all()  # unmatched store
    known = out[out.store_id < 3]
    assert (known[["store_type_a", "store_type_b", "store_type_c"]].sum(axis=1) == 1).all()
    pdf = sales.toPandas().merge(_stores(spark).toPandas(), on="store_id", how="left")
    z = (pdf["size"] - pdf["size"].mean()) / pdf["size"].std()
    assert abs(known["size_normalized"].mean() - z.dropna().mean()) < 1e-9
    assert s3["size_normalized"].isna().all()


def test_engineer_features_rows_and_rename(spark):
    sales = _sales(spark, gaps=True)
    out = fe.engineer_features(sales, _features(spark, drop_every=5), _stores(spark))
    assert out.count() == sales.count()
    assert "feature_date" in out.columns and "date" not in out.columns
    # the fast pipeline equals the step-by-step composition
    step = fe.sales_features_join(sales, _features(spark, drop_every=5))
    step = fe.lag_features(step)
    step = fe.economic_features(step)
    a = out.select("store_id", "dept_id", "feature_date", "sales_lag_1", "fuel_price_change",
                   "temperature_deviation").toPandas().sort_values(["store_id", "dept_id", "feature_date"])
    b = step.select("store_id", "dept_id", F.col("date").alias("feature_date"), "sales_lag_1",
                    "fuel_price_change", "temperature_deviation").toPandas().sort_values(
        ["store_id", "dept_id", "feature_date"])
    for c in ("sales_lag_1", "fuel_price_change", "temperature_deviation"):
        x, y = a[c].values, b[c].values
        assert ((pd.isna(x) & pd.isna(y)) | (abs(x - y) < 1e-9)).all(), c


def test_blocked_windows_match_plain(spark):
    """Long-series blocks (tiny block size to force many blocks) equal the plain windows."""
    from weekcast.operators.series import blocked_windows

    sales = _sales(spark, stores=2, depts=2, weeks=150, gaps=True)

    def build(k, o):
        return fe.lag_columns("weekly_sales", (1, 2, 52), k, o) | fe.rolling_columns("weekly_sales", (4, 13, 52), k, o)

    plain = sales.withColumns(build(["store_id", "dept_id"], ["date"])).toPandas()
    blocked = blocked_windows(sales, ["store_id", "dept_id"], ["date"], build, halo=52, block_rows=60).toPandas()
    key = ["store_id", "dept_id", "date"]
    a = plain.sort_values(key).reset_index(drop=True)
    b = blocked.sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) == sales.count()
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f":
            assert ((x.isna() & y.isna()) | ((x - y).abs() < 1e-6)).all(), c
        else:
            assert (x.astype(str) == y.astype(str)).all(), c


@pytest.mark.parametrize("block_rows", [53, 57, 104])
def test_blocked_windows_block_sizes(spark, block_rows):
    """Block sizes just above the halo and between: still identical to the plain windows."""
    from weekcast.operators.series import blocked_windows

    sales = _sales(spark, stores=1, depts=3, weeks=230, gaps=True, seed=block_rows)

    def build(k, o):
        return fe.lag_columns("weekly_sales", (1, 52), k, o) | fe.rolling_columns("weekly_sales", (4, 52), k, o)

    key = ["store_id", "dept_id", "date"]
    a = sales.withColumns(build(["store_id", "dept_id"], ["date"])).toPandas().sort_values(key).reset_index(drop=True)
    b = blocked_windows(sales, ["store_id", "dept_id"], ["date"], build, halo=52,
                        block_rows=block_rows).toPandas().sort_values(key).reset_index(drop=True)
    assert len(a) == len(b)
    for c in ["sales_lag_1", "sales_lag_52", "rolling_mean_4", "rolling_std_52", "rolling_min_4"]:
        x, y = a[c].astype(float), b[c].astype(float)
        assert ((x.isna() & y.isna()) | ((x - y).abs() < 1e-6)).all(), c
