"""Mergeable rollups behind the history pages: increments are added to a state instead of reading all rows again.

A delivery of rows (an increment) becomes two small tables, written below its own name:

* ``totals``  one row per date and store: rows, rows with sales, exact sum of sales, of holiday sales, holiday flag;
* ``sets``    one row per date, kind of id (store, department) and block of 32,768 ids: a bitmap of the ids.

Sums add up, flags take the larger value, bitmaps join by OR, so the state of all increments is a merge of
theirs in any order, and distinct counts stay exact, which counts of counts would not be. An
increment that is delivered again overwrites its own part. ``compact`` merges the increments so far into one.

The views give the rows of the full aggregates of ``operators.explore`` over all rows delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.plans.joins import with_scalars

KINDS = {"store": "store_id", "dept": "dept_id"}


def totals(df: DataFrame, date_col: str = "feature_date") -> DataFrame:
    sales = F.col("weekly_sales")
    return df.groupBy(F.col(date_col).alias("date"), "store_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(sales).alias("n_sales"), F.sum(sales).alias("sales"),
        F.sum(F.when(F.col("is_holiday"), sales)).alias("holiday_sales"), F.max(F.col("is_holiday").cast("int")).alias("is_holiday"))


def sets(df: DataFrame, date_col: str = "feature_date") -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("id")) for k, c in KINDS.items()]))
    ids = df.select(F.col(date_col).alias("date"), kinds.alias("k")).select("date", "k.*").where("id IS NOT NULL")
    return ids.groupBy("date", "kind", F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("ids"))


def _merged_totals(parts: DataFrame) -> DataFrame:
    kind = {f.name: f.dataType for f in parts.schema.fields}
    add = [F.sum(c).cast(kind[c]).alias(c) for c in ("n_rows", "n_sales", "sales", "holiday_sales")]
    return parts.groupBy("date", "store_id").agg(*add, F.max("is_holiday").alias("is_holiday"))


def _merged_sets(parts: DataFrame) -> DataFrame:
    return parts.groupBy("date", "kind", "block").agg(F.bitmap_or_agg("ids").alias("ids"))


def append(df: DataFrame, path: str, increment: str, date_col: str = "feature_date") -> None:
    """Adds the rows of ``df`` under the increment's name; the same name again replaces its part."""
    sets(df, date_col).write.mode("overwrite").parquet(f"{path}/sets/increment={increment}")
    totals(df, date_col).write.mode("overwrite").parquet(f"{path}/totals/increment={increment}")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the merge of all increments as the only one of a new state at ``to``."""
    state = Rollup(spark, path)
    state.sets.write.mode("overwrite").parquet(f"{to}/sets/increment=merged")
    state.totals.write.mode("overwrite").parquet(f"{to}/totals/increment=merged")


class Rollup:
    """The merged state at ``path`` and its views."""

    def __init__(self, spark: SparkSession, path: str):
        self.totals = _merged_totals(spark.read.parquet(f"{path}/totals"))
        self.sets = _merged_sets(spark.read.parquet(f"{path}/sets"))

    def _distinct(self, kind: str, name: str, *by: str) -> DataFrame:
        """How many ids of a kind there are (per ``by``): the bits of its blocks."""
        blocks = self.sets.where(F.col("kind") == kind).groupBy(*by, "block").agg(F.bitmap_or_agg("ids").alias("ids"))
        return blocks.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("ids")), F.lit(0)).alias(name))

    def weekly_history(self, date_col: str = "feature_date") -> DataFrame:
        out = self.totals.groupBy("date").agg(F.sum("sales").alias("weekly_sales"), F.max("is_holiday").alias("is_holiday"))
        for kind in KINDS:
            out = out.join(self._distinct(kind, f"{kind}_count", "date"), "date", "left").fillna(0, [f"{kind}_count"])
        return out.withColumnRenamed("date", date_col)

    def explorer_summary(self) -> DataFrame:
        mean: Column = F.try_divide(F.sum("sales").cast("double"), F.sum("n_sales"))
        return self.totals.agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_records"), F.sum("sales").alias("total_sales"), mean.alias("avg_weekly_sales"),
            F.countDistinct("date").alias("weeks"))

    def sales_over_time(self, date_col: str = "feature_date") -> DataFrame:
        out = self.totals.groupBy("date").agg(F.sum("sales").alias("total_sales"), F.sum("holiday_sales").alias("holiday_sales"))
        return out.withColumnRenamed("date", date_col)

    def sales_by_store_week(self, date_col: str = "feature_date") -> DataFrame:
        return self.totals.select(F.col("date").alias(date_col), "store_id", F.col("sales").alias("weekly_sales"))

    def store_coverage(self, stores: DataFrame) -> DataFrame:
        out = with_scalars(self._distinct("store", "stores_with_sales"), stores.agg(F.count(F.lit(1)).alias("total_stores")))
        return out.withColumn("all_covered", F.col("stores_with_sales") == F.col("total_stores"))
