"""The engineered feature table kept up to date week by week.

``engineer_features`` looks back 52 rows in a series and takes means over a store's whole history, so a
rebuild reads everything. Here a new week costs its own rows and those of the series and stores it
touches:

* **Halo.** One row a series with its last ``HALO`` sales. A new row's lags and rolling windows are
  computed over the halo and the batch, in the same frames and order as in a rebuild.
* **Stores.** One row a store with running sums (rows, temperature) and the values of its last week, from which the
  changes of the next one are taken.
* **Table.** The engineered rows of every batch, never rewritten. The two columns that a later week
  changes for all rows, the temperature's deviation from the store's mean and the size
  in standard deviations, are not stored: ``read`` adds them from the stores' sums, one join with one row a store.

Every batch is a generation: a folder that holds the batch's rows and the state after it, whose last file marks it
as complete. A batch that was killed is not complete, and when it comes again its folder is written anew;
readers see complete generations only. A batch must be later than all before it (its first date after the
last one known), which is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcast.functions.calendar import temporal_columns
from weekcast.operators import features as fe
from weekcast.plans.joins import with_scalars

#: Rows of a series that the widest window or lag looks back.
HALO = max(*fe.LAGS, *fe.WINDOWS)
SUM = "decimal(38,6)"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def generations(spark: SparkSession, path: str) -> int:
    """How many batches are complete."""
    n = 0
    while _exists(spark, f"{path}/generation={n:06d}/stores/_SUCCESS"):
        n += 1
    return n


def _at(path: str, n: int, what: str) -> str:
    return f"{path}/generation={n:06d}/{what}"


def append(sales: DataFrame, features: DataFrame, stores: DataFrame, path: str) -> int:
    """Adds the batch ``sales`` with the ``features`` of its weeks; returns the number of batches now in the table.

    The first batch is the initial load. An empty batch changes nothing.
    """
    spark = sales.sparkSession
    n = generations(spark, path)
    span = sales.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if span.lo is None:
        return n
    halo = known = None
    if n:
        halo, known = (spark.read.parquet(_at(path, n - 1, what)) for what in ("halo", "stores"))
        last = known.agg(F.max("last_date")).first()[0]
        if span.lo <= last:
            raise ValueError(f"the batch begins on {span.lo}, the table ends on {last}: batches must come in order")
    series = list(fe.SERIES)

    # lags and rolling windows over the halo of the batch's series and the batch
    own = sales.select(*series, "date", "weekly_sales", F.lit(True).alias("_new"))
    if halo is not None:
        held = halo.join(sales.select(*series).distinct(), series, "left_semi").select(*series, F.explode("rows").alias("r"))
        own = held.select(*series, "r.date", "r.weekly_sales", F.lit(False).alias("_new")).unionByName(own)
    windowed = fe.lag_columns("weekly_sales") | fe.rolling_columns("weekly_sales")
    looked_back = own.withColumns(windowed).where("_new").select(*series, "date", *windowed)
    rows = sales.join(looked_back, [*series, "date"]).join(_context(sales, features, stores, known), ["store_id", "date"], "left")
    md = fe.markdown_columns()
    change = {
        f"{c}_change": F.col(c) - F.when(F.col("dept_id") == F.col("_first"), F.col(f"_prev_{c}")).otherwise(F.col(c))
        for c in fe.ECONOMIC
    }
    rows.select(
        *sales.columns, "temperature", "fuel_price", *[md[m].alias(m) for m in fe.MARKDOWNS], "cpi", "unemployment",
        *[c.alias(name) for name, c in temporal_columns(F.col("date")).items()], *windowed,
        *[c.alias(name) for name, c in change.items()], *[md[c].alias(c) for c in ("total_markdown", "has_markdown", "markdown_count")],
        "store_type_a", "store_type_b", "store_type_c",
    ).sortWithinPartitions("date").write.mode("overwrite").parquet(_at(path, n, "rows"))

    # the state after the batch
    newest = F.slice(F.sort_array(F.collect_list(F.struct("date", "weekly_sales")), asc=False), 1, HALO)
    after = own.groupBy(*series).agg(F.reverse(newest).alias("rows"))
    if halo is not None:
        after = after.unionByName(halo.join(after.select(*series), series, "left_anti"))
    after.write.mode("overwrite").parquet(_at(path, n, "halo"))
    _sums(sales, features, stores, known).write.mode("overwrite").parquet(_at(path, n, "stores"))
    return n + 1


def _days(sales: DataFrame, features: DataFrame) -> DataFrame:
    """One row per store and week of the batch: first department, rows, feature values."""
    keys = sales.groupBy("store_id", "date").agg(F.min("dept_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return keys.join(features.select("store_id", "date", *fe._FEATURE_VALUES), ["store_id", "date"], "left")


def _context(sales: DataFrame, features: DataFrame, stores: DataFrame, known: DataFrame | None) -> DataFrame:
    """Feature values, the values of the store's week before, and the one-hot type, of every store and week of the batch."""
    days = _days(sales, features).join(stores.select("store_id", "store_type"), "store_id", "left")
    if known is not None:
        before = known.select("store_id", F.col("last_date").alias("date"), *[F.col(f"last_{c}").alias(c) for c in fe.ECONOMIC])
        days = days.unionByName(before, allowMissingColumns=True)
    by_date = Window.partitionBy("store_id").orderBy("date")
    days = days.withColumns({f"_prev_{c}": F.lag(c).over(by_date) for c in fe.ECONOMIC}).where("_n IS NOT NULL")
    return days.select(
        "store_id", "date", "_first", *fe._FEATURE_VALUES, *[f"_prev_{c}" for c in fe.ECONOMIC],
        *[c.alias(name) for name, c in fe.one_hot_columns(F.col("store_type")).items()],
    )


def _sums(sales: DataFrame, features: DataFrame, stores: DataFrame, known: DataFrame | None) -> DataFrame:
    """The stores' running sums and last values after the batch."""
    days = _days(sales, features)
    t = F.col("temperature")
    latest = F.max(F.struct("date", *fe.ECONOMIC)).alias("last")
    batch = days.groupBy("store_id").agg(
        F.sum("_n").alias("n_rows"), F.sum((t * F.col("_n")).cast(SUM)).cast(SUM).alias("t_sum"),
        F.sum(F.when(t.isNotNull(), F.col("_n"))).alias("t_rows"), latest,
    ).select("store_id", "n_rows", "t_sum", "t_rows", F.col("last.date").alias("last_date"), *[F.col(f"last.{c}").alias(f"last_{c}") for c in fe.ECONOMIC])
    if known is not None:
        both = known.drop("size").unionByName(batch)
        latest = F.max(F.struct("last_date", *[f"last_{c}" for c in fe.ECONOMIC])).alias("last")
        batch = both.groupBy("store_id").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("t_sum").cast(SUM).alias("t_sum"), F.sum("t_rows").alias("t_rows"), latest
        ).select("store_id", "n_rows", "t_sum", "t_rows", "last.*")
    return batch.join(stores.select("store_id", "size"), "store_id", "left")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as ``engineer_features`` would make it from all batches."""
    n = generations(spark, path)
    if not n:
        raise ValueError(f"no batch is complete in {path}")
    rows = spark.read.parquet(*[_at(path, k, "rows") for k in range(n)])
    known = spark.read.parquet(_at(path, n - 1, "stores"))
    sizes = fe._size_stats(known, "size", "n_rows")
    per_store = with_scalars(known, sizes).select(
        "store_id", F.try_divide(F.col("t_sum").cast("double"), F.col("t_rows")).alias("_tmean"), fe._size_z().alias("size_normalized"))
    out = rows.join(per_store, "store_id", "left").withColumn("temperature_deviation", F.col("temperature").cast("double") - F.col("_tmean"))
    order = [c for c in rows.columns if not c.endswith("_change") and c not in ("total_markdown", "has_markdown", "markdown_count") and not c.startswith("store_type_")]
    rest = [c for c in rows.columns if c not in order]
    return out.select(*order, "temperature_deviation", *rest, "size_normalized").withColumnRenamed("date", "feature_date")
