"""Benchmark the headline queries on data that grows with the scale factor.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
(default 8) and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "rows": {...}, "sf": ...}``.

Panel queries run on the supplier grain, whose row count grows with the scale
factor (523,000 sales rows at sf0.1; the nation grain stays near 53,000 at any
scale). ``load_tables`` and ``write_engineered_table`` are timed cold and, as
``*_warm``, a second time into fresh folders. Queries are timed to completion with the
``noop`` sink (full execution, no driver collect), three runs each, the fastest
counts. Training is timed once, with ``TRAIN_ROUNDS`` boosting rounds. Session
start-up and one trivial warm-up job run before the clock starts; ``rows`` has
the input rows of each query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weekcast.session import get_spark  # noqa: E402

TRAIN_ROUNDS = 10
RAW = ["duplicate_keys", "missing_children"]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark("weekcast-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    from pyspark.sql import functions as F

    from weekcast.operators import anomaly, explore, features, forecast, inventory, metrics, model, report
    from weekcast.plans import catalog
    from weekcast.session import scratch_path
    from weekcast.sources import adapter

    # JVM start-up and the first trivial job are not timed
    spark.range(1000).selectExpr("sum(id)").collect()

    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, fn, n, runs=3):
        best = None
        for _ in range(runs):
            t = time.time()
            fn()
            el = time.time() - t
            best = el if best is None else min(best, el)
        times[name], rows[name] = round(best, 3), n

    def load(tag):
        base = scratch_path(spark, f"bench-{tag}")
        for name, df in adapter.retail_tables(spark, sf_dir, grain="supplier", written=False).items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        return {n: spark.read.parquet(f"{base}/{n}") for n in ("raw_sales", "features", "stores")}

    lineitems = adapter.read_table(spark, sf_dir, "lineitem").count()
    timed("load_tables", lambda: load("cold"), lineitems, 1)
    timed("load_tables_warm", lambda: load("warm"), lineitems, 1)
    t = load("warm")
    sales, feats, stores = t["raw_sales"], t["features"], t["stores"]
    n = sales.count()

    def engineered():
        return features.engineer_features(sales, feats, stores)

    path = scratch_path(spark, "bench-engineered")
    timed("write_engineered_table", lambda: engineered().write.mode("overwrite").parquet(path), n, 1)
    timed("write_engineered_table_warm", lambda: engineered().write.mode("overwrite").parquet(path), n, 1)
    eng = spark.read.parquet(path)

    def predictions():
        return eng.select("weekly_sales", F.coalesce("sales_lag_1", "weekly_sales").alias("p"), "is_holiday")

    queries = {
        "engineer_features": engineered,
        "temporal_features": lambda: features.temporal_features(sales),
        "lag_features": lambda: features.lag_features(sales),
        "rolling_features": lambda: features.rolling_features(sales),
        "generate_forecasts": lambda: forecast.generate_forecasts(eng),
        "evaluate_model": lambda: metrics.evaluate_model(predictions(), y="weekly_sales", p="p"),
        "zscore_anomalies": lambda: anomaly.zscore_anomalies(eng),
        "weekly_history": lambda: explore.weekly_history(eng),
        "avg_by_store_dept": lambda: explore.avg_by_store_dept(eng),
        "safety_stock": lambda: inventory.safety_stock(forecast.generate_forecasts(eng)),
        "history_summary": lambda: report.history_summary(eng),
        "sales_box_by_store": lambda: explore.box_summary(eng, ["store_id"]),
        "correlation_matrix": lambda: explore.correlation_matrix(eng, ["weekly_sales", "temperature", "fuel_price", "cpi", "unemployment"]),
    }
    for name, fn in queries.items():
        timed(name, lambda fn=fn: _run(fn()), n)
    for name in RAW:
        timed(name, lambda name=name: _run(catalog.QUERIES[name](spark, sf_dir)), lineitems)

    fitted = []
    timed(f"train_forecaster_{TRAIN_ROUNDS}_rounds", lambda: fitted.append(model.train_forecaster(eng, params={"maxIter": TRAIN_ROUNDS})[0]), n, 1)
    timed("score_model", lambda: _run(model.score(fitted[0], eng)), n)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
