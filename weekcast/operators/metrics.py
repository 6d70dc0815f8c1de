"""Forecast accuracy metrics as aggregates (one pass; partial + final hash aggregation).

* ``wmae``            holiday-weighted MAE, weight 5 on holiday weeks, 1 otherwise
* ``evaluate_model``  wmae, mae, rmse, mape (mape over y != 0) in one aggregate,
                      globally or per group
* ``forecast_accuracy`` mae, mape and matched row count after an inner join of
                      actuals and predictions on (store, dept, date); this mape
                      divides by the signed actual without a zero guard in the
                      original, here ``try_divide`` makes a zero actual NULL
* ``forecast_bias``   mean(pred - actual), mean(actual), bias in percent
* ``improvement_vs_baseline`` (baseline - wmae) / baseline * 100
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Holiday weight and the WMAE of the published baseline.
HOLIDAY_WEIGHT = 5
REGULAR_WEIGHT = 1
BASELINE_WMAE = 821.0


def holiday_weight(is_holiday: Column) -> Column:
    return F.when(is_holiday, F.lit(HOLIDAY_WEIGHT)).otherwise(F.lit(REGULAR_WEIGHT))


def _err(y: str, p: str) -> Column:
    return F.col(p).cast("double") - F.col(y).cast("double")


def metric_columns(y: str = "weekly_sales", p: str = "predicted_sales",
                   holiday: str = "is_holiday") -> list[Column]:
    e = _err(y, p)
    w = holiday_weight(F.col(holiday))
    yd = F.col(y).cast("double")
    return [
        F.try_divide(F.sum(w * F.abs(e)), F.sum(w)).alias("wmae"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(yd != 0, F.abs(e / yd))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    ]


def wmae(df: DataFrame, y: str = "weekly_sales", p: str = "predicted_sales",
         holiday: str = "is_holiday") -> DataFrame:
    w = holiday_weight(F.col(holiday))
    return df.agg(F.try_divide(F.sum(w * F.abs(_err(y, p))), F.sum(w)).alias("wmae"))


def evaluate_model(df: DataFrame, y: str = "weekly_sales", p: str = "predicted_sales",
                   holiday: str = "is_holiday", by: Sequence[str] = ()) -> DataFrame:
    cols = metric_columns(y, p, holiday)
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def forecast_accuracy(actual: DataFrame, predicted: DataFrame,
                      keys: Sequence[str] = ("store_id", "dept_id", "feature_date"),
                      y: str = "weekly_sales", p: str = "predicted_sales") -> DataFrame:
    m = actual.join(predicted, list(keys), "inner")
    e = F.abs(F.col(y).cast("double") - F.col(p).cast("double"))
    return m.agg(
        F.avg(e).alias("mae"),
        (F.avg(F.try_divide(e, F.col(y).cast("double"))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("num_comparisons"),
    )


def forecast_bias(df: DataFrame, y: str = "weekly_sales", p: str = "predicted_sales") -> DataFrame:
    g = df.agg(F.avg(_err(y, p)).alias("mean_error"), F.avg(F.col(y).cast("double")).alias("mean_actual"))
    return g.withColumn("bias_pct", F.try_divide(F.abs(F.col("mean_error")) * 100, F.col("mean_actual")))


def improvement_vs_baseline(wmae_col: Column, baseline: float = BASELINE_WMAE) -> Column:
    return (F.lit(baseline) - wmae_col) / F.lit(baseline) * 100


class WMAEEvaluator:
    """Spark ML evaluator form of WMAE (lower is better), usable with ``CrossValidator``.

    Built lazily so importing this module does not need a running JVM.
    """

    def __new__(cls, labelCol: str = "label", predictionCol: str = "prediction", holidayCol: str = "is_holiday"):
        from pyspark.ml.evaluation import Evaluator

        class _WMAE(Evaluator):
            def _evaluate(self, dataset):
                flag = F.col(holidayCol).cast("boolean")
                return wmae(dataset.withColumn("_h", flag), labelCol, predictionCol, "_h").first()["wmae"]

            def isLargerBetter(self):
                return False

        return _WMAE()
