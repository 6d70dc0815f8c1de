"""The incremental feature table against full rebuilds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weekcast.operators import features as fe
from weekcast.operators import increments as inc


def _panel(spark, weeks=70, seed=2):
    rnd = random.Random(seed)
    start = dt.date(2020, 1, 6)
    sales, feats = [], []
    for s in (1, 2, 3):
        for w in range(weeks):
            date = start + dt.timedelta(weeks=w)
            if s == 3 and (w < weeks - 2 or w == weeks - 1):
                continue  # a store that begins with the next to last week and misses the last one
            for d in (1, 2, 5):
                if rnd.random() < 0.85:
                    sales.append((s, d, date, round(rnd.uniform(10, 99), 2) if rnd.random() < 0.95 else None, w % 6 == 0))
            if rnd.random() < 0.9:
                feats.append((s, date, round(rnd.uniform(0, 30), 2) if rnd.random() < 0.9 else None, 2.5 + w / 100, *[round(rnd.uniform(-1, 3), 2) if rnd.random() < 0.5 else None for _ in range(5)], 120.0 + w, 3.0 + w / 50))
    sales = spark.createDataFrame(sales, "store_id int, dept_id int, date date, weekly_sales double, is_holiday boolean")
    names = "store_id int, date date, temperature double, fuel_price double, markdown1 double, markdown2 double, markdown3 double, markdown4 double, markdown5 double, cpi double, unemployment double"
    feats = spark.createDataFrame(feats, names).selectExpr("store_id", "date", "CAST(temperature AS DECIMAL(5,2)) AS temperature", *[f"CAST({c} AS DECIMAL(18,4)) AS {c}" for c in ("fuel_price", "cpi", "unemployment")], *[f"CAST(markdown{k} AS DECIMAL(18,2)) AS markdown{k}" for k in range(1, 6)])
    stores = spark.createDataFrame([(1, "A", 100), (2, "B", 250)], "store_id int, store_type string, size int")
    return sales.withColumn("weekly_sales", F.col("weekly_sales").cast("decimal(18,2)")), feats, stores


def _rows(df):
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.columns, sorted(map(str, df.select(*rounded).collect()))


def test_three_appended_weeks_equal_a_rebuild(spark, tmp_path):
    sales, feats, stores = (x.cache() for x in _panel(spark))
    weeks = [r.date for r in sales.select("date").distinct().orderBy("date").collect()]
    path = str(tmp_path / "t")
    assert inc.append(sales.where(F.col("date") < weeks[-3]), feats, stores, path) == 1
    for n, week in enumerate(weeks[-3:]):
        now = sales.where(F.col("date") == week)
        assert inc.append(now, feats.where(F.col("date") == week), stores, path) == n + 2
        assert _rows(inc.read(spark, path)) == _rows(fe.engineer_features(sales.where(F.col("date") <= week), feats, stores))


def test_a_killed_batch_is_not_seen_and_comes_again(spark, tmp_path, monkeypatch):
    sales, feats, stores = _panel(spark, 20)
    weeks = [r.date for r in sales.select("date").distinct().orderBy("date").collect()]
    first, later = sales.where(F.col("date") < weeks[12]), sales.where(F.col("date") >= weeks[12])
    path = str(tmp_path / "t")
    inc.append(first, feats, stores, path)
    with monkeypatch.context() as m:
        m.setattr(inc, "_sums", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            inc.append(later, feats, stores, path)
    assert inc.generations(spark, path) == 1 and inc.read(spark, path).count() == first.count()
    assert inc.append(later, feats, stores, path) == 2
    assert _rows(inc.read(spark, path)) == _rows(fe.engineer_features(sales, feats, stores))
    with pytest.raises(ValueError):
        inc.append(later, feats, stores, path)
    assert inc.append(later.limit(0), feats, stores, path) == 2


def test_a_new_week_reads_halo_and_stores_only(spark, tmp_path, monkeypatch):
    sales, feats, stores = _panel(spark, 12)
    path = str(tmp_path / "t")
    weeks = [r.date for r in sales.select("date").distinct().orderBy("date").collect()]
    inc.append(sales.where(F.col("date") < weeks[-1]), feats, stores, path)
    asked = []
    real = inc._at
    monkeypatch.setattr(inc, "_at", lambda path, n, what: asked.append((n, what)) or real(path, n, what))
    assert inc.append(sales.where(F.col("date") == weeks[-1]), feats, stores, path) == 2
    assert {what for n, what in asked if n == 0} == {"halo", "stores"}
    with pytest.raises(ValueError):
        inc.read(spark, str(tmp_path / "none"))
