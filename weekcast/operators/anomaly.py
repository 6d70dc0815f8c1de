"""Z-score anomaly detection over a scope of weekly sales.

One mean and one sample std for the whole scope (a global aggregate, attached
to every row as a broadcast one-row table), ``|x - mean| / std`` per row,
strict ``>`` threshold; a zero std flags nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.plans.joins import with_scalars

DEFAULT_THRESHOLD = 3.0
TOP_N = 20


def zscore_stats(df: DataFrame, value: str = "weekly_sales") -> DataFrame:
    x = F.col(value)
    return df.agg(
        F.try_divide(F.sum(x).cast("double"), F.count(x)).alias("_mean"),
        F.stddev_samp(x.cast("double")).alias("_std"),
    )


def zscore_scores(df: DataFrame, value: str = "weekly_sales") -> DataFrame:
    """Every row with ``z_score`` and ``deviation`` (= z * std)."""
    s = with_scalars(df, zscore_stats(df, value))
    z = F.abs(F.try_divide(F.col(value).cast("double") - F.col("_mean"),
                           F.when(F.col("_std") > 0, F.col("_std"))))
    return s.withColumn("z_score", z).withColumn("deviation", F.col("z_score") * F.col("_std")).drop("_mean", "_std")


def zscore_anomalies(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, value: str = "weekly_sales") -> DataFrame:
    return zscore_scores(df, value).where(F.col("z_score") > F.lit(threshold))


def anomaly_top(anomalies: DataFrame, n: int = TOP_N, order_by: str = "input",
                date_col: str = "feature_date") -> DataFrame:
    """The first ``n`` anomalies: ``"input"`` = newest date first (the scan order of the
    original), ``"z"`` = largest z first; keys break ties."""
    if order_by == "z":
        o = [F.col("z_score").desc(), F.col(date_col).desc(), "store_id", "dept_id"]
    else:
        o = [F.col(date_col).desc(), "store_id", "dept_id"]
    return anomalies.orderBy(*o).limit(n)


def anomaly_summary(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, value: str = "weekly_sales",
                    date_col: str = "feature_date") -> DataFrame:
    """One row: records, date range, mean, std, uncapped anomaly count, threshold."""
    scored = zscore_scores(df, value)
    return scored.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(date_col).alias("min_date"),
        F.max(date_col).alias("max_date"),
        F.try_divide(F.sum(value).cast("double"), F.count(value)).alias("avg_sales"),
        F.stddev_samp(F.col(value).cast("double")).alias("sales_std"),
        F.count_if(F.col("z_score") > F.lit(threshold)).alias("anomalies_found"),
    ).withColumn("detection_threshold", F.lit(threshold))
