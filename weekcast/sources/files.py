"""Typed scans of the retail files and tables.

CSV files are read with an explicit schema (never ``inferSchema``) and renamed
by position, as the loaders of the original do: the stores file has header
``Store,Type,Size`` and carriage-return-only line ends (Spark's CSV reader
accepts ``\\r``, ``\\n`` and ``\\r\\n``); the features file marks missing values
``NA``. Parquet scans select columns and push filters into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.schema import FEATURES, FEATURES_CSV_COLUMNS, MONEY, SALES_CSV_COLUMNS, STORES_CSV_COLUMNS

_STORES_CSV = "c0 int, c1 string, c2 int"
_SALES_CSV = f"c0 int, c1 int, c2 string, c3 {MONEY.simpleString()}, c4 string"


def _features_csv_schema() -> str:
    return ", ".join(f"c{i} {f.dataType.simpleString() if f.name not in ('date', 'is_holiday') else 'string'}"
                     for i, f in enumerate(FEATURES.fields))


def scan_stores(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(_STORES_CSV).option("header", True).csv(path)
    return df.toDF(*STORES_CSV_COLUMNS)


def _bool(c):
    return F.lower(F.trim(c)).isin("true", "1", "t", "yes")


def scan_sales(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    df = spark.read.schema(_SALES_CSV).option("header", True).csv(path).toDF(*SALES_CSV_COLUMNS)
    return df.withColumns({"date": F.to_date("date", date_format), "is_holiday": _bool(F.col("is_holiday"))})


def scan_features(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Features CSV; ``NA`` and empty fields are NULL.

    A missing holiday flag becomes true, as the original's boolean conversion
    of a missing value does.
    """
    df = (spark.read.schema(_features_csv_schema()).option("header", True).option("nullValue", "NA")
          .csv(path).toDF(*FEATURES_CSV_COLUMNS))
    return df.withColumns({"date": F.to_date("date", date_format),
                           "is_holiday": F.coalesce(_bool(F.col("is_holiday")), F.lit(True))})


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where=None) -> DataFrame:
    """Parquet table scan; ``columns`` and ``where`` reach the reader (pruning, pushed filters)."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if where is not None:
        df = df.where(where)
    return df


def training_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def training_scan_filtered(spark: SparkSession, path: str) -> DataFrame:
    """The alternative training read: only rows with a last-week value, no NULL filling."""
    return spark.read.parquet(path).where(F.col("sales_lag_1").isNotNull())
