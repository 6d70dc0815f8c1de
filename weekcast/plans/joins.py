"""Attaching one-row aggregates, and written intermediates.

Joins to dimension-like sides are plain joins: Spark broadcasts a side whose
measured bytes are below its threshold and shuffles otherwise, splitting hot
partitions (AQE), so no row counts are taken while a plan is built.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.session import scratch_path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and continue from the copy."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate (a global ``agg``) to every row.

    A global aggregate has exactly one row, so broadcasting it is bounded by
    construction; this replaces ``Window.partitionBy()`` with no keys, which
    would pull every row into a single task.
    """
    return df.crossJoin(F.broadcast(one_row))
