"""Exploration queries behind the sales dashboard: filters, profiles, weekly
series, forecast roll-ups, distributions, pivots, correlations, top-N lists.

All are aggregates with map-side partial aggregation or filters pushed to the
Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.operators.stats import exact_quantiles
from weekcast.plans.joins import with_scalars


# --------------------------------------------------------------------------- filters

def filter_scope(df: DataFrame, store: int | None = None, dept: int | None = None,
                 store_col: str = "store_id", dept_col: str = "dept_id") -> DataFrame:
    """Optional store / dept filter; ``None`` means all."""
    if store is not None:
        df = df.where(F.col(store_col) == store)
    if dept is not None:
        df = df.where(F.col(dept_col) == dept)
    return df


def explore_filter(df: DataFrame, start, end, stores: Sequence[int] = (), depts: Sequence[int] = (),
                   date_col: str = "feature_date", limit: int | None = None) -> DataFrame:
    """Rows with date BETWEEN start AND end, store / dept IN lists (empty = all), newest first.

    With ``limit`` this is a top-N (``TakeOrderedAndProject``: each task keeps
    its N best rows, so the final merge holds N x tasks rows); ties on date are
    broken by store and dept so the result is deterministic.
    """
    out = df.where(F.col(date_col).between(F.lit(start), F.lit(end)))
    if stores:
        out = out.where(F.col("store_id").isin(list(stores)))
    if depts:
        out = out.where(F.col("dept_id").isin(list(depts)))
    out = out.orderBy(F.col(date_col).desc(), "store_id", "dept_id")
    return out.limit(limit) if limit else out


def text_search(df: DataFrame, pattern: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column, as text, matches the regex ``pattern`` case-insensitively."""
    cols = list(cols or df.columns)
    cond = None
    for c in cols:
        m = F.coalesce(F.col(c).cast("string").rlike("(?i)" + pattern), F.lit(False))
        cond = m if cond is None else (cond | m)
    return df.where(cond)


def since(df: DataFrame, col: str, start) -> DataFrame:
    return df.where(F.col(col) >= F.lit(start))


def holiday_rows(df: DataFrame, flag: str = "is_holiday") -> DataFrame:
    return df.where(F.col(flag))


# --------------------------------------------------------------------------- profiles (A1-A4)

def table_profile(sales: DataFrame, stores: DataFrame, features: DataFrame, date_col: str = "date") -> DataFrame:
    """One row: stores, sales and feature row counts, sales date range, distinct departments."""
    s = sales.agg(F.count(F.lit(1)).alias("sales_rows"), F.min(date_col).alias("min_date"),
                  F.max(date_col).alias("max_date"), F.countDistinct("dept_id").alias("departments"))
    st = stores.agg(F.count(F.lit(1)).alias("stores"))
    fe = features.agg(F.count(F.lit(1)).alias("feature_rows"))
    return with_scalars(with_scalars(s, st), fe).select(
        "stores", "sales_rows", "feature_rows", "min_date", "max_date", "departments")


def quick_stats(stores: DataFrame, sales: DataFrame, engineered: DataFrame) -> DataFrame:
    a = stores.agg(F.countDistinct("store_id").alias("total_stores"))
    b = sales.agg(F.countDistinct("dept_id").alias("departments"))
    c = engineered.agg(F.max("feature_date").alias("latest_date"))
    return with_scalars(with_scalars(a, b), c)


def filter_options(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    out = df.select(col).distinct().orderBy(col)
    return out.limit(limit) if limit else out


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# --------------------------------------------------------------------------- weekly series

def weekly_history(df: DataFrame, date_col: str = "feature_date") -> DataFrame:
    """Per date: total sales, holiday flag as 0/1, distinct stores and departments."""
    return df.groupBy(date_col).agg(
        F.sum("weekly_sales").alias("weekly_sales"),
        F.max(F.col("is_holiday").cast("int")).alias("is_holiday"),
        F.countDistinct("store_id").alias("store_count"),
        F.countDistinct("dept_id").alias("dept_count"),
    )


def forecast_by_week(fc: DataFrame) -> DataFrame:
    """Per forecast date: summed prediction and summed bounds."""
    return fc.groupBy("forecast_date").agg(
        F.sum("predicted_sales").alias("predicted_sales"),
        F.sum("prediction_lower").alias("lower_bound"),
        F.sum("prediction_upper").alias("upper_bound"),
    )


def forecast_summary(fc: DataFrame, history: DataFrame | None) -> DataFrame:
    """Total forecast, mean of weekly totals, number of weeks, growth vs mean weekly history total.

    ``history`` is the output of ``weekly_history``; growth is 0 when its mean is <= 0.
    """
    weekly = fc.groupBy("forecast_date").agg(F.sum("predicted_sales").alias("wk"))
    f = weekly.agg(
        F.sum("wk").alias("total_forecast"),
        F.avg(F.col("wk").cast("double")).alias("avg_weekly_forecast"),
        F.count(F.lit(1)).alias("forecast_weeks"),
    )
    if history is None:
        return f.withColumn("growth_pct", F.lit(None).cast("double"))
    h = history.agg(F.avg(F.col("weekly_sales").cast("double")).alias("hist_avg"))
    out = with_scalars(f, h)
    growth = F.when(F.col("hist_avg") > 0,
                    (F.col("avg_weekly_forecast") / F.col("hist_avg") - 1) * 100).otherwise(F.lit(0.0))
    return out.withColumn("growth_pct", growth).drop("hist_avg")


def explorer_summary(df: DataFrame, date_col: str = "feature_date") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum("weekly_sales").alias("total_sales"),
        F.avg(F.col("weekly_sales").cast("double")).alias("avg_weekly_sales"),
        F.countDistinct(date_col).alias("weeks"),
    )


def sales_over_time(df: DataFrame, date_col: str = "feature_date") -> DataFrame:
    """Per date: total sales and total over holiday rows (NULL on dates without holiday rows)."""
    return df.groupBy(date_col).agg(
        F.sum("weekly_sales").alias("total_sales"),
        F.sum(F.when(F.col("is_holiday"), F.col("weekly_sales"))).alias("holiday_sales"),
    )


def sales_by_store_week(df: DataFrame, date_col: str = "feature_date") -> DataFrame:
    return df.groupBy(date_col, "store_id").agg(F.sum("weekly_sales").alias("weekly_sales"))


def avg_by_store_dept(df: DataFrame, limit: int | None = None) -> DataFrame:
    out = (df.groupBy("store_id", "dept_id")
           .agg(F.avg(F.col("weekly_sales").cast("double")).alias("avg_sales"))
           .orderBy("store_id", "dept_id"))
    return out.limit(limit) if limit else out


def store_coverage(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Distinct stores with sales vs number of stores in the dimension."""
    a = sales.agg(F.countDistinct("store_id").alias("stores_with_sales"))
    b = stores.agg(F.count(F.lit(1)).alias("total_stores"))
    return with_scalars(a, b).withColumn("all_covered", F.col("stores_with_sales") == F.col("total_stores"))


# --------------------------------------------------------------------------- distributions

def sales_histogram(df: DataFrame, col: str = "weekly_sales", bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max]; the maximum falls in the last bin."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins)))
    binned = with_scalars(df.where(x.isNotNull()), rng).withColumn("bin", b.cast("int"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return binned.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count")).select(
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * width).alias("bin_end"),
        "count",
    )


def box_summary(df: DataFrame, by: Sequence[str], col: str = "weekly_sales") -> DataFrame:
    """Five-number summary per group (exact quartiles, linear interpolation) and row count."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"])
    x = F.col(col).cast("double")
    mm = df.groupBy(*by).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    return mm.join(q, list(by), "left").select(*by, "min", "q1", "median", "q3", "max", "n")


def store_dept_heatmap(df: DataFrame, stores: Sequence[int]) -> DataFrame:
    """Mean sales per (dept, store), the given stores as columns ``store_<id>``; absent cells NULL.

    The columns are the caller's choice; ``store_dept_means`` is the long form for any number of stores.
    """
    ids = list(stores)
    p = (df.groupBy("dept_id").pivot("store_id", ids)
         .agg(F.avg(F.col("weekly_sales").cast("double"))))
    return p.select("dept_id", *[F.col(str(i)).alias(f"store_{i}") for i in ids])


def store_dept_means(df: DataFrame) -> DataFrame:
    """Mean sales per (dept, store), one row per cell that has rows."""
    return df.groupBy("dept_id", "store_id").agg(F.avg(F.col("weekly_sales").cast("double")).alias("avg_sales"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every ordered pair of ``cols`` (pairwise-complete rows), long form.

    ``covar_samp / (std_a * std_b)`` over rows where both are present; a
    constant column gives NULL (pandas NaN) instead of a divide-by-zero error.
    """
    aggs = []
    for a, b in combinations(cols, 2):
        xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
        both = xa.isNotNull() & xb.isNotNull()
        aggs.append(F.try_divide(
            F.covar_samp(F.when(both, xa), F.when(both, xb)),
            F.stddev_samp(F.when(both, xa)) * F.stddev_samp(F.when(both, xb))).alias(f"{a}|{b}"))
    for a in cols:
        xa = F.col(a).cast("double")
        aggs.append(F.when(F.stddev_samp(xa) > 0, F.lit(1.0)).alias(f"{a}|{a}"))
    wide = df.agg(*aggs)
    pairs = [(a, b) for a in cols for b in cols]
    key = lambda a, b: f"{a}|{b}" if f"{a}|{b}" in wide.columns else f"{b}|{a}"
    stack = ", ".join(f"'{a}', '{b}', `{key(a, b)}`" for a, b in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)")


# --------------------------------------------------------------------------- sorts / top-N

def newest_rows(df: DataFrame, n: int, date_col: str = "feature_date",
                tie: Sequence[str] = ("store_id", "dept_id")) -> DataFrame:
    return df.orderBy(F.col(date_col).desc(), *tie).limit(n)


def last_n_weeks(weekly: DataFrame, n: int = 20, date_col: str = "feature_date") -> DataFrame:
    """The last ``n`` rows of a per-date series (a top-N on date)."""
    return weekly.orderBy(F.col(date_col).desc()).limit(n)


# --------------------------------------------------------------------------- set operations

def replicate_rows(df: DataFrame, times: int) -> DataFrame:
    """The frame repeated ``times`` times (``pd.concat([df] * times)``), as a join with a tiny range."""
    reps = df.sparkSession.range(times).withColumnRenamed("id", "_rep")
    return df.crossJoin(F.broadcast(reps)).drop("_rep")


def history_and_forecast(history: DataFrame, fc_weekly: DataFrame) -> DataFrame:
    """One timeline: (date, series, value, lower, upper) with history then forecast rows."""
    h = history.select(F.col("feature_date").alias("date"), F.lit("history").alias("series"),
                       F.col("weekly_sales").cast("double").alias("value"),
                       F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    f = fc_weekly.select(F.col("forecast_date").alias("date"), F.lit("forecast").alias("series"),
                         F.col("predicted_sales").cast("double").alias("value"),
                         F.col("lower_bound").cast("double").alias("lower"),
                         F.col("upper_bound").cast("double").alias("upper"))
    return h.unionByName(f)
