"""Model operators: cleaning, splits, training, scoring, persistence, metadata views."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from weekcast.operators import model as mo


def _eng(spark, n_weeks=30, seed=42):
    rnd = random.Random(seed)
    rows = []
    for s in (1, 2):
        for d in (1, 2):
            prev = None
            for w in range(n_weeks):
                y = rnd.uniform(5000, 50000)
                rows.append((s, d, dt.date(2011, 2, 4) + dt.timedelta(weeks=w), y, prev,
                             y if w else None, rnd.random() < 0.1, rnd.uniform(30, 90), float("nan") if w == 3 else 1.0))
                prev = y
    return spark.createDataFrame(rows, "store_id int, dept_id int, feature_date date, weekly_sales double, "
                                       "sales_lag_1 double, rolling_mean_4 double, is_holiday boolean, "
                                       "temperature double, size_normalized double")


def test_clean_training(spark):
    df = _eng(spark)
    c = mo.clean_training(df)
    # the first row of each series has sales_lag_1 and rolling_mean_4 both NULL -> dropped
    assert c.count() == df.count() - 4
    r = c.agg(F.sum(F.col("size_normalized").isNull().cast("int")).alias("nul"),
              F.sum(F.isnan("size_normalized").cast("int")).alias("nan")).first()
    assert r.nul == 0 and r.nan == 0
    assert dict(c.dtypes)["is_holiday"] == "int"


def test_time_split_inclusive(spark):
    s = mo.time_split(_eng(spark), val_weeks=8)
    dates = s.where("is_validation").select("feature_date").distinct().count()
    assert dates == 9  # 8 weeks back, inclusive


def test_random_split_deterministic(spark):
    df = _eng(spark)
    a1, b1 = mo.random_split(df, ["store_id", "dept_id", "feature_date"])
    a2, _ = mo.random_split(df.repartition(7), ["store_id", "dept_id", "feature_date"])
    assert a1.count() + b1.count() == df.count()
    assert sorted(map(tuple, a1.select("store_id", "dept_id", "feature_date").collect())) == \
        sorted(map(tuple, a2.select("store_id", "dept_id", "feature_date").collect()))


def test_not_trained_errors(spark):
    with pytest.raises(ValueError):
        mo.score(None, _eng(spark), ["temperature"])
    with pytest.raises(ValueError):
        mo.save_model(None, "/nonexistent")
    with pytest.raises(ValueError):
        mo.feature_importance(spark, None, [])


def test_train_score_save_load(spark):
    df = _eng(spark)
    model, feats, metrics = mo.train_forecaster(df, params={"maxIter": 5, "maxDepth": 3, "minInstancesPerNode": 1})
    assert "is_holiday" in feats and "store_id" not in feats and "weekly_sales" not in feats
    m = metrics.first()
    assert m.n > 0 and m.wmae >= 0 and m.rmse >= m.mae
    # every row is predicted, also without a target, with NULL inputs or with a feature missing
    scored = mo.score(model, df.drop("temperature"))
    assert scored.count() == df.count() and scored.where("prediction IS NULL").count() == 0
    blank = df.withColumns({"weekly_sales": F.lit(None).cast("double"), "sales_lag_1": F.lit(None).cast("double"), "rolling_mean_4": F.lit(None).cast("double")})
    assert mo.score(model, blank).count() == df.count()
    assert mo.score(model, df.drop("weekly_sales")).columns == [*[c for c in df.columns if c != "weekly_sales"], "prediction"]
    assert mo.model_features(model) == feats
    path = os.path.join(tempfile.mkdtemp(prefix="weekcast-model-"), "m")
    loaded = mo.load_model(mo.save_model(model, path))
    a = sorted(r.prediction for r in mo.score(model, df, feats).collect())
    b = sorted(r.prediction for r in mo.score(loaded, df, feats).collect())
    assert a == pytest.approx(b)
    imp = mo.feature_importance(spark, model, feats)
    meta = mo.model_metadata(spark, metrics, imp, run_id="r1")
    share = mo.importance_share(meta).collect()
    assert abs(sum(r.importance_pct for r in share) - 100) < 1e-6 
    cats = {r.category for r in mo.importance_by_category(meta).collect()}
    assert cats <= {"Lag Features", "Rolling Statistics", "Temporal Features", "Economic Indicators",
                    "Markdown Features", "Store Features", "Other"}
    assert mo.latest_model(meta).first().run_id == "r1"
    table = os.path.join(tempfile.mkdtemp(prefix="weekcast-meta-"), "t")
    mo.append_metadata(meta, table)
    later = mo.model_metadata(spark, metrics, imp, run_id="r2", training_date=dt.datetime(2999, 1, 1))
    mo.append_metadata(later, table)
    stored = spark.read.parquet(table)
    assert stored.count() == 2 and mo.latest_model(stored).first().run_id == "r2"


def test_train_without_holiday_column(spark):
    df = _eng(spark).drop("is_holiday")
    _, feats, metrics = mo.train_forecaster(df, params={"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 1})
    m = metrics.first()
    assert "is_holiday" not in feats and m.wmae == pytest.approx(m.mae)  # all weights 1
