"""Feature engineering on the weekly panel (store x dept x week).

Operators (each ``DataFrame -> DataFrame``):

* ``sales_features_join``  left join of sales to store-week features (sales holiday flag kept)
* ``temporal_features``    ISO week, month, quarter, calendar month start / end
* ``lag_features``         row lags of the target within each series
* ``rolling_features``     rolling mean / sample std (and min / max for window 4),
                           current row included like the original; ``closed="left"``
                           gives the leak-free variant
* ``economic_features``    change of fuel price / CPI / unemployment along each store's
                           rows ordered by (date, dept), and temperature minus the
                           store mean over its rows
* ``markdown_features``    markdowns null -> 0, total, flag, count of active markdowns
* ``store_features``       left join to stores, type one-hot, z-score of size over rows
* ``engineer_features``    the whole pipeline (flagship)

Partitioning: lag/rolling windows share one ``partitionBy(store, dept).orderBy(date)``
and are built in one projection, so the plan has one exchange and one sort for
all of them. A series holds one row per week ((store, dept, date) is unique,
see ``quality.duplicate_keys``), so a window partition is bounded by the
calendar, not by the data volume. Store-level values (changes, store means,
one-hot, size z-score) are computed on a (store, week) table that is one row
per store-week, then joined to the rows once; Spark picks the join by measured
size. For frames whose series are not bounded so, ``operators.series`` has the
same windows over exact overlapping blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.calendar import temporal_columns
from weekcast.plans.joins import with_scalars
from weekcast.schema import MARKDOWNS

SERIES = ("store_id", "dept_id")
LAGS = (1, 2, 4, 8, 52)
WINDOWS = (4, 13, 52)
ECONOMIC = ("fuel_price", "cpi", "unemployment")
STORE_TYPES = ("A", "B", "C")


# --------------------------------------------------------------------------- J1

def sales_features_join(sales: DataFrame, features: DataFrame,
                        keys: Sequence[str] = ("store_id", "date")) -> DataFrame:
    """Left join keeping every sales row and the sales ``is_holiday`` flag."""
    feat = features.drop("is_holiday") if "is_holiday" in sales.columns else features
    return sales.join(feat, list(keys), "left")


# --------------------------------------------------------------------------- X1

def temporal_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(temporal_columns(F.col(date)))


# --------------------------------------------------------------------------- W1-W4

def _series_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def lag_columns(target: str = "weekly_sales", lags: Sequence[int] = LAGS,
                keys: Sequence[str] = SERIES, order: Sequence[str] = ("date",),
                prefix: str = "sales_lag_") -> dict[str, Column]:
    w = _series_window(keys, order)
    return {f"{prefix}{n}": F.lag(target, n).over(w) for n in lags}


def rolling_columns(target: str = "weekly_sales", windows: Sequence[int] = WINDOWS,
                    keys: Sequence[str] = SERIES, order: Sequence[str] = ("date",),
                    closed: str = "right", minmax: Sequence[int] = (4,)) -> dict[str, Column]:
    """Rolling statistics over the last ``n`` rows of each series.

    ``closed="right"``: frame ``n-1 PRECEDING .. CURRENT ROW`` (includes the row's
    own target, as the original); ``closed="left"``: ``n PRECEDING .. 1 PRECEDING``.
    The mean is ``SUM/COUNT`` so that a DECIMAL target is summed exactly.
    """
    base = _series_window(keys, order)
    out: dict[str, Column] = {}
    t = F.col(target)
    for n in windows:
        w = base.rowsBetween(-(n - 1), 0) if closed == "right" else base.rowsBetween(-n, -1)
        out[f"rolling_mean_{n}"] = F.try_divide(F.sum(t).over(w).cast("double"), F.count(t).over(w))
        out[f"rolling_std_{n}"] = F.stddev_samp(t).over(w)
        if n in minmax:
            out[f"rolling_min_{n}"] = F.min(t).over(w)
            out[f"rolling_max_{n}"] = F.max(t).over(w)
    return out


def lag_features(df: DataFrame, lags: Sequence[int] = LAGS, target: str = "weekly_sales",
                 keys: Sequence[str] = SERIES, order: Sequence[str] = ("date",),
                 prefix: str = "sales_lag_") -> DataFrame:
    """Row lags per series."""
    return df.withColumns(lag_columns(target, lags, keys, order, prefix))


def rolling_features(df: DataFrame, windows: Sequence[int] = WINDOWS, target: str = "weekly_sales",
                     keys: Sequence[str] = SERIES, order: Sequence[str] = ("date",),
                     closed: str = "right") -> DataFrame:
    return df.withColumns(rolling_columns(target, windows, keys, order, closed))


# --------------------------------------------------------------------------- W5-W6

def economic_features(df: DataFrame, store: str = "store_id", date: str = "date",
                      tie: str = "dept_id", change_cols: Sequence[str] = ECONOMIC,
                      deviation_col: str = "temperature") -> DataFrame:
    """Changes along each store's rows ordered by (date, tie), and deviation from the store mean.

    Exact for any frame with unique (store, date, tie). Instead of one window per
    store (a hot store would land in one task), the previous row is found in two
    bounded steps: inside a (store, date) group by ``tie`` order; for the first
    row of a group, the last row of the store's previous date, taken from a
    one-row-per-(store, date) table.
    """
    day = df.groupBy(store, date).agg(
        F.min(tie).alias("_first"),
        *[F.max_by(c, tie).alias(f"_last_{c}") for c in change_cols],
        F.sum(deviation_col).alias("_dsum"),
        F.count(deviation_col).alias("_dcnt"),
    )
    wd = Window.partitionBy(store).orderBy(date)
    ws = Window.partitionBy(store)
    day = day.select(
        store, date, "_first",
        *[F.lag(f"_last_{c}").over(wd).alias(f"_prev_{c}") for c in change_cols],
        F.try_divide(F.sum("_dsum").over(ws).cast("double"), F.sum("_dcnt").over(ws)).alias("_dmean"),
    )
    out = df.join(day, [store, date], "left")
    wg = Window.partitionBy(store, date).orderBy(tie)
    cols = {
        f"{deviation_col}_deviation": F.col(deviation_col).cast("double") - F.col("_dmean"),
    }
    for c in change_cols:
        prev = F.when(F.col(tie) == F.col("_first"), F.col(f"_prev_{c}")).otherwise(F.lag(c).over(wg))
        cols[f"{c}_change"] = F.col(c) - prev
    drop = ["_first", "_dmean"] + [f"_prev_{c}" for c in change_cols]
    return out.withColumns(cols).drop(*drop)


# --------------------------------------------------------------------------- X3

def markdown_columns(markdowns: Sequence[str] = MARKDOWNS) -> dict[str, Column]:
    filled = [F.coalesce(F.col(m), F.lit(0)) for m in markdowns]
    total = filled[0]
    for c in filled[1:]:
        total = total + c
    count = (filled[0] > 0).cast("int")
    for c in filled[1:]:
        count = count + (c > 0).cast("int")
    cols = {m: f for m, f in zip(markdowns, filled)}
    cols["total_markdown"] = total
    cols["has_markdown"] = (total > 0).cast("int")
    cols["markdown_count"] = count
    return cols


def markdown_features(df: DataFrame, markdowns: Sequence[str] = MARKDOWNS) -> DataFrame:
    """Fill missing markdowns with 0; total, has-markdown flag (total > 0), count of markdowns > 0."""
    # withColumns evaluates every expression against the input, and each one
    # already coalesces the markdowns, so filling and totals happen in one projection
    return df.withColumns(markdown_columns(markdowns))


# --------------------------------------------------------------------------- J2, X4, W7

def one_hot_columns(type_col: Column, values: Sequence[str] = STORE_TYPES) -> dict[str, Column]:
    return {f"store_type_{v.lower()}": F.coalesce((type_col == v).cast("int"), F.lit(0)) for v in values}


def _size_stats(weighted: DataFrame, size: str = "size", n: str = "_n") -> DataFrame:
    """Mean and sample std of ``size`` over rows, from (size, row count) pairs.

    Integer sums in DECIMAL(38,0) make the variance numerator exact.
    """
    s = F.col(size).cast("decimal(38,0)")
    k = F.col(n).cast("decimal(38,0)")
    g = weighted.where(F.col(size).isNotNull()).agg(
        F.sum(k).alias("_N"), F.sum(k * s).alias("_S1"), F.sum(k * s * s).alias("_S2")
    )
    N, S1, S2 = F.col("_N"), F.col("_S1"), F.col("_S2")
    var = F.try_divide((S2 * N - S1 * S1).cast("double"), (N * (N - F.lit(1))).cast("double"))
    return g.select(
        F.try_divide(S1.cast("double"), N.cast("double")).alias("_size_mean"),
        F.sqrt(var).alias("_size_std"),
    )


def _size_z(size: str = "size") -> Column:
    return F.try_divide(F.col(size).cast("double") - F.col("_size_mean"), F.col("_size_std"))


def store_features(df: DataFrame, stores: DataFrame, key: str = "store_id") -> DataFrame:
    """Left join to stores; one-hot store type (0 when unmatched); size z-score over the rows."""
    per_store = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    st = per_store.join(stores.select(key, "store_type", "size"), key, "left")
    st = with_scalars(st, _size_stats(st)).select(
        key, *[c.alias(n) for n, c in one_hot_columns(F.col("store_type")).items()],
        _size_z().alias("size_normalized"),
    )
    return df.join(st, key, "left")


# --------------------------------------------------------------------------- X5

_FEATURE_VALUES = ["temperature", "fuel_price", *MARKDOWNS, "cpi", "unemployment"]


def store_week_context(sales: DataFrame, features: DataFrame, stores: DataFrame) -> DataFrame:
    """One row per (store, date) present in ``sales`` with every store-level feature.

    Carries the feature values, the first dept of the week (the row whose change
    is taken against the previous week), the previous week's values, the store
    temperature mean over its sales rows, store one-hot and size z-score.
    """
    keys = sales.groupBy("store_id", "date").agg(
        F.min("dept_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    feat = features.select("store_id", "date", *_FEATURE_VALUES)
    st = stores.select("store_id", "store_type", "size")
    # size statistics over sales rows from per-store row counts (one row per store)
    per_store = keys.groupBy("store_id").agg(F.sum("_n").alias("_n")).join(st, "store_id", "left")
    size_stats = _size_stats(per_store)
    day = keys.join(feat, ["store_id", "date"], "left").join(st, "store_id", "left")
    wd = Window.partitionBy("store_id").orderBy("date")
    ws = Window.partitionBy("store_id")
    t = F.col("temperature")
    day = day.withColumns(
        {f"_prev_{c}": F.lag(c).over(wd) for c in ECONOMIC}
        | {
            "_tmean": F.try_divide(
                F.sum(t * F.col("_n")).over(ws).cast("double"),
                F.sum(F.when(t.isNotNull(), F.col("_n"))).over(ws),
            )
        }
    )
    day = with_scalars(day, size_stats)
    return day.select(
        "store_id", "date", "_first", *_FEATURE_VALUES,
        *[f"_prev_{c}" for c in ECONOMIC], "_tmean",
        *[c.alias(n) for n, c in one_hot_columns(F.col("store_type")).items()],
        _size_z().alias("size_normalized"),
    )


def engineer_features(sales: DataFrame, features: DataFrame, stores: DataFrame,
                      lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS,
                      closed: str = "right") -> DataFrame:
    """Sales + features + stores -> one row per sales row with all engineered features.

    Same rows and values as the sequence join -> temporal -> lag -> rolling ->
    economic -> markdown -> store -> rename(date -> feature_date). Plan: the
    one shuffle by (store, dept) of the narrow sales rows feeds every lag/rolling
    window, and the store-week context (rows = stores x weeks), built on its own,
    is joined to the result once.
    """
    ctx = store_week_context(sales, features, stores)
    windowed = lag_columns("weekly_sales", lags) | rolling_columns("weekly_sales", windows, closed=closed)
    df = sales.withColumns(windowed).join(ctx, ["store_id", "date"], "left")
    d = F.col("date")
    md = markdown_columns()
    change = {
        f"{c}_change": F.col(c) - F.when(F.col("dept_id") == F.col("_first"), F.col(f"_prev_{c}"))
        .otherwise(F.col(c))
        for c in ECONOMIC
    }
    out = df.select(
        *sales.columns,
        "temperature", "fuel_price", *[md[m].alias(m) for m in MARKDOWNS], "cpi", "unemployment",
        *[c.alias(n) for n, c in temporal_columns(d).items()],
        *windowed,
        (F.col("temperature").cast("double") - F.col("_tmean")).alias("temperature_deviation"),
        *[c.alias(n) for n, c in change.items()],
        md["total_markdown"].alias("total_markdown"),
        md["has_markdown"].alias("has_markdown"),
        md["markdown_count"].alias("markdown_count"),
        "store_type_a", "store_type_b", "store_type_c", "size_normalized",
    )
    return out.withColumnRenamed("date", "feature_date")
