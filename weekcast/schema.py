"""Typed schemas of the six retail tables.

Money columns are DECIMAL(18,2) rather than the DECIMAL(12,2) of the original
DDL: a weekly sum over a large source overflows 10^10, and under ANSI mode an
overflowing cast fails the job. Every other precision follows the DDL.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

STORES = T.StructType(
    [
        T.StructField("store_id", T.IntegerType(), False),
        T.StructField("store_type", T.StringType(), True),
        T.StructField("size", T.IntegerType(), True),
    ]
)

RAW_SALES = T.StructType(
    [
        T.StructField("store_id", T.IntegerType(), False),
        T.StructField("dept_id", T.IntegerType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("weekly_sales", MONEY, False),
        T.StructField("is_holiday", T.BooleanType(), False),
    ]
)

MARKDOWNS = [f"markdown{k}" for k in range(1, 6)]

FEATURES = T.StructType(
    [
        T.StructField("store_id", T.IntegerType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("temperature", T.DecimalType(5, 2), True),
        T.StructField("fuel_price", T.DecimalType(5, 3), True),
    ]
    + [T.StructField(m, MONEY, True) for m in MARKDOWNS]
    + [
        T.StructField("cpi", T.DecimalType(12, 7), True),
        T.StructField("unemployment", T.DecimalType(5, 3), True),
        T.StructField("is_holiday", T.BooleanType(), True),
    ]
)

# Column order of the sales and features CSV files (positional rename on read).
SALES_CSV_COLUMNS = ["store_id", "dept_id", "date", "weekly_sales", "is_holiday"]
FEATURES_CSV_COLUMNS = [
    "store_id", "date", "temperature", "fuel_price",
    "markdown1", "markdown2", "markdown3", "markdown4", "markdown5",
    "cpi", "unemployment", "is_holiday",
]
STORES_CSV_COLUMNS = ["store_id", "store_type", "size"]

# Stored columns of engineered_features, in write order, with their declared types.
ENGINEERED = T.StructType(
    [
        T.StructField("store_id", T.IntegerType()),
        T.StructField("dept_id", T.IntegerType()),
        T.StructField("feature_date", T.DateType()),
        T.StructField("weekly_sales", MONEY),
        T.StructField("week_of_year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("quarter", T.IntegerType()),
        T.StructField("is_month_start", T.BooleanType()),
        T.StructField("is_month_end", T.BooleanType()),
        T.StructField("is_holiday", T.BooleanType()),
    ]
    + [T.StructField(f"sales_lag_{n}", MONEY) for n in (1, 2, 4, 8, 52)]
    + [T.StructField(f"rolling_mean_{n}", MONEY) for n in (4, 13, 52)]
    + [T.StructField(f"rolling_std_{n}", MONEY) for n in (4, 13)]
    + [
        T.StructField("rolling_min_4", MONEY),
        T.StructField("rolling_max_4", MONEY),
        T.StructField("temperature", T.DecimalType(5, 2)),
        T.StructField("temperature_deviation", T.DecimalType(5, 2)),
        T.StructField("fuel_price", T.DecimalType(5, 3)),
        T.StructField("fuel_price_change", T.DecimalType(5, 3)),
        T.StructField("cpi", T.DecimalType(12, 7)),
        T.StructField("cpi_change", T.DecimalType(12, 7)),
        T.StructField("unemployment", T.DecimalType(5, 3)),
        T.StructField("unemployment_change", T.DecimalType(5, 3)),
        T.StructField("total_markdown", MONEY),
        T.StructField("has_markdown", T.BooleanType()),
        T.StructField("markdown_count", T.IntegerType()),
        T.StructField("store_type_a", T.BooleanType()),
        T.StructField("store_type_b", T.BooleanType()),
        T.StructField("store_type_c", T.BooleanType()),
        T.StructField("size_normalized", T.DecimalType(10, 6)),
    ]
)

FORECASTS = T.StructType(
    [
        T.StructField("store_id", T.IntegerType()),
        T.StructField("dept_id", T.IntegerType()),
        T.StructField("forecast_date", T.DateType()),
        T.StructField("predicted_sales", MONEY),
        T.StructField("prediction_lower", MONEY),
        T.StructField("prediction_upper", MONEY),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("confidence_score", T.DecimalType(5, 4)),
    ]
)

MODEL_METADATA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("wmae", T.DecimalType(10, 2)),
        T.StructField("mae", T.DecimalType(10, 2)),
        T.StructField("rmse", T.DecimalType(10, 2)),
        T.StructField("training_date", T.TimestampType()),
        T.StructField("parameters", T.StringType()),
        T.StructField("feature_importance", T.StringType()),
    ]
)
