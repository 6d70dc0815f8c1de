"""Series windows that stay bounded when one series is very long.

Window functions over ``partitionBy(series keys)`` put a whole series in one
task. A weekly panel is safe (one row per series per week, so a series is
bounded by the calendar), but a single series holding a large share of the
data would not be. ``blocked_windows`` is the form for such frames:

* every row gets its exact 0-based rank inside its series (range-partitioned
  ranking, ``stats.ranks_within_groups``);
* rows are cut into blocks of ``block_rows`` consecutive ranks, and the last
  ``halo`` rows of each block are copied into the next block;
* the windows run over ``partitionBy(keys, block).orderBy(rank)`` and only each
  block's own rows are kept.

A lag of up to ``halo`` rows, or a frame reaching back at most ``halo`` rows,
then sees exactly the rows it would see over the whole series; no task holds
more than ``block_rows + halo`` rows of one series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.operators.stats import ranks_within_groups

DEFAULT_BLOCK_ROWS = 500_000

ColumnBuilder = Callable[[Sequence[str], Sequence[str]], dict[str, Column]]


def blocked_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], build: ColumnBuilder,
                    halo: int, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    if block_rows <= halo:
        raise ValueError("block_rows must exceed the halo")
    keys, order = list(keys), list(order)
    ranked = ranks_within_groups(df, keys, order)
    own = F.floor(F.col("_rank") / block_rows)
    # rows near the end of a block are also needed by the next block
    blocks = F.when(F.col("_rank") >= (own + 1) * block_rows - halo, F.array(own, own + 1)).otherwise(F.array(own))
    x = ranked.withColumn("_own", own).withColumn("_blk", F.explode(blocks))
    out = x.withColumns(build([*keys, "_blk"], ["_rank"]))
    return out.where(F.col("_blk") == F.col("_own")).drop("_rank", "_own", "_blk")
