"""Incremental ingest of weekly sales files with Structured Streaming.

New CSV files dropped into a landing folder are read as a file stream with the
sales schema, parsed like ``scan_sales``, and appended to the sales table under
its UNIQUE (store, dept, date) key in ``foreachBatch``: rows whose key already
exists, and further copies of a key in a micro-batch, go to a rejects table
instead. Each micro-batch owns a partition of either table under its epoch's
name and overwrites it, so a retried epoch changes nothing; the stream's
checkpoint records which files were processed. ``trigger(availableNow=True)``
processes everything present and stops, which suits scheduled loads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekcast.schema import MONEY, SALES_CSV_COLUMNS
from weekcast.sources.sinks import append_unique

SALES_KEYS = ("store_id", "dept_id", "date")


def sales_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    schema = f"store_id int, dept_id int, date string, weekly_sales {MONEY.simpleString()}, is_holiday string"
    r = spark.readStream.schema(schema).option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.csv(landing).toDF(*SALES_CSV_COLUMNS)
    return df.withColumns({
        "date": F.to_date("date"),
        "is_holiday": F.lower(F.trim("is_holiday")).isin("true", "1", "t", "yes"),
    })


def ingest_sales(spark: SparkSession, landing: str, table: str, rejects: str, checkpoint: str,
                 keys: Sequence[str] = SALES_KEYS, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        append_unique(batch, table, keys, date_key="date", rejects=rejects, batch=f"epoch{epoch_id}")

    w = (sales_stream(spark, landing, max_files_per_trigger).writeStream
         .foreachBatch(write_batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
