"""Data-quality checks as Spark jobs (constraints of the original DDL and its tests).

Each check returns a DataFrame of violations or a one-row summary, so it can be
written, counted, or asserted on without collecting the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (UNIQUE / PRIMARY KEY), with their count.

    A hash aggregate with map-side partial counts: a hot key is pre-counted in
    every map task before the shuffle, so it never gathers its rows in one task.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def fk_violations(child: DataFrame, parent: DataFrame, key: str | Sequence[str],
                  parent_key: str | Sequence[str] | None = None) -> DataFrame:
    """Child rows whose key has no parent row (FOREIGN KEY); NULL keys are not violations."""
    keys = [key] if isinstance(key, str) else list(key)
    pkeys = keys if parent_key is None else ([parent_key] if isinstance(parent_key, str) else list(parent_key))
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(pkeys, keys)]).distinct()
    nonnull = child
    for k in keys:
        nonnull = nonnull.where(F.col(k).isNotNull())
    return nonnull.join(p, keys, "left_anti")


def missing_children(parent: DataFrame, child: DataFrame, key: str, child_key: str | None = None) -> DataFrame:
    """Parent rows with no child row (``LEFT JOIN ... WHERE child IS NULL``).

    The child keys are de-duplicated first: the map-side partial aggregation
    collapses a parent with very many children to one row per task before the
    shuffle, so a hot key never reaches the anti join in bulk.
    """
    ck = child_key or key
    c = child.select(F.col(ck).alias(key)).distinct()
    return parent.join(c, key, "left_anti")


def domain_violations(df: DataFrame, col: str, allowed: Sequence) -> DataFrame:
    """Rows whose value is outside ``allowed`` (CHECK ... IN (...)); NULL passes, as in SQL."""
    return df.where(~F.col(col).isin(list(allowed)))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: number of NULLs per column (``SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END)``)."""
    cols = list(cols or df.columns)
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"{c}_nulls") for c in cols])


def not_null_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any NOT NULL column."""
    cond = None
    for c in cols:
        x = F.col(c).isNull()
        cond = x if cond is None else (cond | x)
    return df.where(cond)


def date_range_check(df: DataFrame, col: str, lo_year: int, hi_year: int) -> DataFrame:
    """One row: min/max year of ``col`` and whether both are inside [lo_year, hi_year]."""
    g = df.agg(F.min(F.year(col)).alias("min_year"), F.max(F.year(col)).alias("max_year"))
    return g.withColumn("in_range", (F.col("min_year") >= lo_year) & (F.col("max_year") <= hi_year))


def future_dates(df: DataFrame, col: str, as_of: Column) -> DataFrame:
    """One row: number of rows dated after ``as_of``."""
    return df.agg(F.count_if(F.col(col) > as_of).alias("future_rows"))


def recent_count(df: DataFrame, col: str, as_of: Column, days: int = 30) -> DataFrame:
    """One row: rows with ``col`` within ``days`` before ``as_of`` (inclusive)."""
    return df.agg(F.count_if(F.col(col) >= F.date_sub(as_of, days)).alias("recent_rows"))


def negative_share(df: DataFrame, col: str) -> DataFrame:
    """One row: rows, negative rows and their share in percent."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(col) < 0).alias("negative_rows"),
    ).withColumn("negative_pct", F.try_divide(F.col("negative_rows") * 100.0, F.col("total_rows")))


def interval_check(df: DataFrame, pred: str = "predicted_sales", lo: str = "prediction_lower",
                   hi: str = "prediction_upper", max_width: float = 0.5) -> DataFrame:
    """One row: rows, rows with lower < pred < upper, rows whose (upper-lower)/pred < max_width, and both as all-true flags."""
    inside = (F.col(lo) < F.col(pred)) & (F.col(pred) < F.col(hi))
    width = F.try_divide((F.col(hi) - F.col(lo)).cast("double"), F.col(pred).cast("double"))
    narrow = width < F.lit(max_width)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(inside).alias("inside_rows"),
        F.count_if(narrow).alias("narrow_rows"),
    ).withColumns({
        "all_inside": F.col("inside_rows") == F.col("total_rows"),
        "all_narrow": F.col("narrow_rows") == F.col("total_rows"),
    })


def infinite_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: number of +/-Infinity and NaN values per floating column."""
    fl = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    cols = [c for c in (cols or fl) if c in fl]
    aggs = []
    for c in cols:
        aggs.append(F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))).alias(f"{c}_inf"))
        aggs.append(F.count_if(F.isnan(F.col(c))).alias(f"{c}_nan"))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *aggs)
