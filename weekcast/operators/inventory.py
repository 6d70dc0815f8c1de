"""Inventory summaries over weekly forecasts.

* ``inventory_demand``: per store mean / sample std / sum of predicted weekly
  demand, then the mean of store means, mean of store stds (stores with one
  row have no std and are skipped), total demand, weeks, period, stores, depts.
* ``safety_stock``: per (store, dept) the textbook safety stock and reorder
  point, ``SS = z * sigma * sqrt(L)`` and ``ROP = mu * L + SS`` with ``L`` the
  lead time in weeks and ``z`` the normal quantile of the service level.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.plans.joins import with_scalars

DEFAULT_SERVICE_LEVEL = 0.95
DEFAULT_LEAD_TIME_DAYS = 7


def service_z(service_level: float) -> float:
    return NormalDist().inv_cdf(service_level)


def inventory_demand(fc: DataFrame, service_level: float = DEFAULT_SERVICE_LEVEL,
                     lead_time_days: int = DEFAULT_LEAD_TIME_DAYS) -> DataFrame:
    p = F.col("predicted_sales").cast("double")
    per_store = fc.groupBy("store_id").agg(F.avg(p).alias("m"), F.stddev_samp(p).alias("s"),
                                            F.sum(p).alias("t"))
    a = per_store.agg(F.avg("m").alias("avg_weekly_demand"), F.avg("s").alias("demand_variability_std"),
                      F.sum("t").alias("total_forecasted_demand"))
    b = fc.agg(F.countDistinct("forecast_date").alias("forecast_weeks"),
               F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date"),
               F.countDistinct("store_id").alias("num_stores"), F.countDistinct("dept_id").alias("num_departments"))
    return with_scalars(a, b).withColumns({
        "service_level": F.lit(service_level),
        "lead_time_days": F.lit(lead_time_days),
        "lead_time_weeks": F.lit(lead_time_days / 7.0),
    })


def safety_stock(fc: DataFrame, service_level: float = DEFAULT_SERVICE_LEVEL,
                 lead_time_days: int = DEFAULT_LEAD_TIME_DAYS,
                 keys=("store_id", "dept_id")) -> DataFrame:
    z = service_z(service_level)
    weeks = lead_time_days / 7.0
    p = F.col("predicted_sales").cast("double")
    g = fc.groupBy(*keys).agg(F.avg(p).alias("avg_weekly_demand"), F.stddev_samp(p).alias("demand_std"),
                              F.count(p).alias("weeks"))
    ss = F.lit(z) * F.col("demand_std") * F.lit(weeks ** 0.5)
    return g.withColumns({"safety_stock": ss}).withColumn(
        "reorder_point", F.col("avg_weekly_demand") * F.lit(weeks) + F.col("safety_stock"))
