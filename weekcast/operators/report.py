"""Scope reports over forecasts and history (the tables an analyst reads).

* ``demand_summary``  total / mean / min / max prediction, period, weeks, series
* ``demand_by_store`` mean and sum per store
* ``history_summary`` mean, exact median, sample std, total, date range, weeks
* ``recent_trend``    mean of the last 8 distinct weeks vs the 8 before (needs >= 16 weeks)
* ``multi_scope_report`` everything above plus anomaly and inventory figures for one
  scope, its label and its first flagged rows, as (section, metric, value) text rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions import text as tx
from weekcast.operators import anomaly, explore, inventory
from weekcast.operators.stats import exact_quantiles
from weekcast.plans.joins import with_scalars

# Fixed values of the report (metric names and texts below likewise): a store breakdown for at
# most 10 stores, the first 10 flagged rows in the text, weekly values.
REPORT_STORES = 10
REPORT_ANOMALIES = 10
GRANULARITY = "WEEKLY (each value = one full week of sales)"
TREND_WEEKS = 8


def demand_summary(fc: DataFrame) -> DataFrame:
    p = F.col("predicted_sales")
    return fc.agg(
        F.sum(p).alias("total_predicted"),
        F.avg(p.cast("double")).alias("avg_predicted"),
        F.min(p).alias("min_predicted"),
        F.max(p).alias("max_predicted"),
        F.min("forecast_date").alias("first_date"),
        F.max("forecast_date").alias("last_date"),
        F.countDistinct("forecast_date").alias("num_weeks"),
        F.countDistinct("store_id", "dept_id").alias("num_series"),
    )


def demand_by_store(fc: DataFrame, max_stores: int | None = None) -> DataFrame:
    """Mean and sum of predictions per store, rounded half-up to cents; with ``max_stores`` no
    rows if there are more stores than that.

    The mean is a DECIMAL average (exact sum / count), so the rounding does not
    depend on the order in which the rows were summed.
    """
    p = F.col("predicted_sales").cast("decimal(18,2)")
    per = fc.groupBy("store_id").agg(F.round(F.avg(p), 2).cast("decimal(18,2)").alias("mean"),
                                     F.sum(p).cast("decimal(38,2)").alias("sum"))
    if max_stores is None:
        return per
    n = fc.agg(F.countDistinct("store_id").alias("_stores"))
    return with_scalars(per, n).where(F.col("_stores") <= max_stores).drop("_stores")


def history_summary(hist: DataFrame, date_col: str = "feature_date") -> DataFrame:
    x = F.col("weekly_sales")
    a = hist.agg(
        F.avg(x.cast("double")).alias("avg_weekly_sales"),
        F.stddev_samp(x.cast("double")).alias("std_weekly_sales"),
        F.sum(x).alias("total_sales"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
        F.countDistinct(date_col).alias("num_weeks"),
    )
    med = exact_quantiles(hist, "weekly_sales", [0.5], names=["median_weekly_sales"])
    return with_scalars(a, med)


def recent_trend(hist: DataFrame, weeks: int = TREND_WEEKS, date_col: str = "feature_date") -> DataFrame:
    """Zero rows when fewer than ``2 * weeks`` distinct dates exist.

    The ranking runs on the distinct dates (one row per week, bounded by the
    calendar), which are then joined back to the rows.
    """
    dates = hist.select(date_col).distinct()
    ranked = dates.select(date_col, F.row_number().over(Window.orderBy(F.col(date_col).desc())).alias("_rk"),
                          F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("_nd"))
    ranked = ranked.where(F.col("_rk") <= 2 * weeks)
    # at most 2 * weeks rows by construction: a proven bound, broadcast directly
    rows = hist.join(F.broadcast(ranked), [date_col], "inner")
    x = F.col("weekly_sales").cast("double")
    g = rows.agg(
        F.avg(F.when(F.col("_rk") <= weeks, x)).alias("recent_avg"),
        F.avg(F.when(F.col("_rk") > weeks, x)).alias("prior_avg"),
        F.max("_nd").alias("_nd"),
    )
    return (g.where(F.col("_nd") >= 2 * weeks)
            .withColumn("trend_pct", F.try_divide(F.col("recent_avg") - F.col("prior_avg"), F.col("prior_avg")) * 100)
            .drop("_nd"))


def _rows(df: DataFrame, section: str, spec: list[tuple[str, Column]]) -> DataFrame:
    """One-row frame -> (section, metric, value) text rows, one per ``spec`` entry."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), e.cast("string").alias("value")) for m, e in spec])
    return df.select(F.lit(section).alias("section"), F.explode(items).alias("_i")).select(
        "section", "_i.metric", "_i.value")


def _store_rows(fc: DataFrame) -> DataFrame:
    """The per-store breakdown as text rows, for scopes of at most ``REPORT_STORES`` stores."""
    items = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("string").alias("value")) for m in ("mean", "sum")])
    per = demand_by_store(fc, REPORT_STORES).select("store_id", F.explode(items).alias("_i"))
    return per.select(F.lit("forecast_by_store").alias("section"),
                      F.concat(F.lit("store "), F.col("store_id").cast("string"), F.lit(" "), F.col("_i.m")).alias("metric"), "_i.value")


def _anomaly_rows(flagged: DataFrame) -> DataFrame:
    """The first flagged rows as text rows: sales, z-score and deviation of a date, store and department."""
    first = anomaly.anomaly_top(flagged, REPORT_ANOMALIES)
    metric = F.concat_ws(" ", F.col("feature_date").cast("string"), F.lit("store"), F.col("store_id").cast("string"),
                         F.lit("department"), F.col("dept_id").cast("string"))
    value = F.concat(F.lit("sales "), tx.format_currency(F.col("weekly_sales")), F.lit(", z-score "), tx.format_fixed(F.col("z_score"), 2),
                     F.lit(", deviation "), F.format_number("deviation", 2))
    return first.select(F.lit("anomaly_details").alias("section"), metric.alias("metric"), value.alias("value"))


def _period(a: str, b: str) -> Column:
    return F.concat(F.col(a).cast("string"), F.lit(" to "), F.col(b).cast("string"))


def multi_scope_report(fc: DataFrame, hist: DataFrame, store: int | None = None, dept: int | None = None,
                       service_level: float = inventory.DEFAULT_SERVICE_LEVEL,
                       lead_time_days: int = inventory.DEFAULT_LEAD_TIME_DAYS,
                       threshold: float = anomaly.DEFAULT_THRESHOLD) -> DataFrame:
    """Forecast, history, trend, inventory and anomaly figures of one scope as text rows.

    Values are rendered the way the original hands them over: money as
    ``$1,234.50``, the trend as ``+1.2%``, periods as ``first to last``.
    """
    f = explore.filter_scope(fc, store, dept)
    h = explore.filter_scope(hist, store, dept)
    cur = tx.format_currency
    ds = demand_summary(f)
    hs = history_summary(h)
    tr = recent_trend(h)
    inv = inventory.inventory_demand(f, service_level, lead_time_days)
    an = anomaly.anomaly_summary(h, threshold)
    parts = [
        _rows(ds, "forecast_summary", [
            ("data_granularity", F.lit(GRANULARITY)),
            ("total_predicted_weekly_sales", cur(F.col("total_predicted"))),
            ("avg_predicted_weekly_sales", cur(F.col("avg_predicted"))),
            ("min_predicted_weekly_sales", cur(F.col("min_predicted"))),
            ("max_predicted_weekly_sales", cur(F.col("max_predicted"))),
            ("forecast_period", _period("first_date", "last_date")),
            ("num_weeks_forecasted", F.col("num_weeks")),
            ("num_store_dept_combinations", F.col("num_series")),
        ]),
        _rows(hs, "historical_summary", [
            ("data_granularity", F.lit(GRANULARITY)),
            ("avg_weekly_sales", cur(F.col("avg_weekly_sales"))),
            ("median_weekly_sales", cur(F.col("median_weekly_sales"))),
            ("std_weekly_sales", cur(F.col("std_weekly_sales"))),
            ("total_historical_sales", cur(F.col("total_sales"))),
            ("historical_date_range", _period("first_date", "last_date")),
            ("num_historical_weeks", F.col("num_weeks")),
        ]),
        _rows(tr, "recent_trend", [
            ("recent_8wk_avg", cur(F.col("recent_avg"))),
            ("prior_8wk_avg", cur(F.col("prior_avg"))),
            ("trend_change_pct", tx.format_pct(F.col("trend_pct"))),
        ]),
        _rows(inv, "demand_analysis", [
            ("avg_weekly_demand", cur(F.col("avg_weekly_demand"))),
            ("demand_variability_std", cur(F.col("demand_variability_std"))),
            ("total_forecasted_demand", cur(F.col("total_forecasted_demand"))),
            ("forecast_weeks", F.col("forecast_weeks")),
            ("forecast_period", _period("first_date", "last_date")),
            ("num_stores", F.col("num_stores")),
            ("num_departments", F.col("num_departments")),
            ("service_level_target", F.concat(F.format_number(F.col("service_level") * 100, 0), F.lit("%"))),
            ("lead_time", F.concat(F.col("lead_time_days").cast("string"), F.lit(" days"))),
            ("lead_time_as_weeks", F.concat(tx.format_fixed(F.col("lead_time_weeks")), F.lit(" weeks"))),
        ]),
        _rows(an, "anomalies", [
            ("total_records", F.col("total_records")),
            ("date_range", _period("min_date", "max_date")),
            ("avg_sales", cur(F.col("avg_sales"))),
            ("sales_std", cur(F.col("sales_std"))),
            ("anomalies_found", F.col("anomalies_found")),
            ("detection_threshold", tx.format_fixed(F.col("detection_threshold"))),
        ]),
    ]
    parts += [_store_rows(f), _anomaly_rows(anomaly.zscore_anomalies(h, threshold))]
    scope = ", ".join([*([f"Store {store}"] if store is not None else []), *([f"Department {dept}"] if dept is not None else [])])
    if scope:
        parts.append(_rows(ds, "scope", [("scope", F.lit(scope))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
