"""Multi-week forecast tables: latest row per series, future-week grid, calendar
features of the forecast weeks, scoring, and prediction intervals.

``generate_forecasts`` is one DataFrame plan: the latest row of every series
(semi join against a per-series max, no shuffle of the feature table when the
series table is small enough to broadcast), ``explode(sequence(1, weeks))``
for the future weeks, the calendar columns, one batch scoring pass over all
series x weeks rows, and the interval arithmetic. Lag / rolling / economic
features stay frozen at the last known values, as in the original.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.functions.calendar import forecast_calendar_columns
from weekcast.plans.joins import with_scalars
from weekcast.schema import MONEY

# Fixed values of the forecast table.
FORECAST_WEEKS = 8
INTERVAL_Z = 1.96
RELATIVE_STD = 0.15
MIN_STD = 100.0
BASE_CONFIDENCE = 0.85
CONFIDENCE_STEP = 0.02
GROWTH_FACTOR = 1.05

Predictor = Callable[[DataFrame], DataFrame]


def latest_per_key(df: DataFrame, keys: Sequence[str] = ("store_id", "dept_id"),
                   date_col: str = "feature_date") -> DataFrame:
    """Rows at their own series' last date (ties keep all rows)."""
    last = df.groupBy(*keys).agg(F.max(date_col).alias(date_col))
    return df.join(last, [*keys, date_col], "left_semi")


def forecast_grid(latest: DataFrame, weeks: int = FORECAST_WEEKS, date_col: str = "feature_date") -> DataFrame:
    """Every latest row x the next ``weeks`` weeks after the global last date.

    Adds ``forecast_date`` and ``horizon`` (0-based week index).
    """
    last = latest.agg(F.max(date_col).alias("_last"))
    g = with_scalars(latest, last).withColumn("_w", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    return g.withColumns({
        "forecast_date": F.date_add(F.col("_last"), F.col("_w") * 7),
        "horizon": F.col("_w") - 1,
    }).drop("_w", "_last")


def forecast_calendar(df: DataFrame, date_col: str = "forecast_date") -> DataFrame:
    return df.withColumns(forecast_calendar_columns(F.col(date_col)))


def interval_columns(pred: Column, horizon: Column) -> dict[str, Column]:
    p = F.greatest(pred.cast("double"), F.lit(0.0))
    s = F.greatest(p * F.lit(RELATIVE_STD), F.lit(MIN_STD))
    return {
        "predicted_sales": p.cast(MONEY),
        "prediction_lower": F.greatest(p - F.lit(INTERVAL_Z) * s, F.lit(0.0)).cast(MONEY),
        "prediction_upper": (p + F.lit(INTERVAL_Z) * s).cast(MONEY),
        "confidence_score": (F.lit(BASE_CONFIDENCE) - F.lit(CONFIDENCE_STEP) * horizon).cast("decimal(5,4)"),
    }


def growth_proxy(df: DataFrame, target: str = "weekly_sales") -> DataFrame:
    """Deterministic predictor: last known sales x 1.05 (the sample-data rule of the original)."""
    return df.withColumn("prediction", F.col(target).cast("double") * F.lit(GROWTH_FACTOR))


def generate_forecasts(engineered: DataFrame, predictor: Predictor = growth_proxy,
                       weeks: int = FORECAST_WEEKS, model_name: str = "gbt_forecaster",
                       model_version: str = "v1.0") -> DataFrame:
    latest = latest_per_key(engineered)
    # the forecast week's calendar replaces the latest row's calendar columns
    cal = forecast_calendar_columns(F.col("forecast_date"))
    grid = forecast_grid(latest).drop(*[c for c in cal if c in latest.columns])
    scored = predictor(grid.withColumns(cal))
    iv = interval_columns(F.col("prediction"), F.col("horizon"))
    return scored.select(
        "store_id", "dept_id", "forecast_date",
        iv["predicted_sales"].alias("predicted_sales"),
        iv["prediction_lower"].alias("prediction_lower"),
        iv["prediction_upper"].alias("prediction_upper"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        iv["confidence_score"].alias("confidence_score"),
    )


def forecast_stats(fc: DataFrame) -> DataFrame:
    """Rows, stores, departments, mean prediction, first and last forecast date."""
    return fc.agg(
        F.count(F.lit(1)).alias("n_forecasts"),
        F.countDistinct("store_id").alias("n_stores"),
        F.countDistinct("dept_id").alias("n_depts"),
        F.avg(F.col("predicted_sales").cast("double")).alias("avg_predicted_sales"),
        F.min("forecast_date").alias("first_date"),
        F.max("forecast_date").alias("last_date"),
    )
