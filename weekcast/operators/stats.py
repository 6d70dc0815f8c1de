"""Exact ranks and order statistics without gathering a group into one task.

Spark's exact ``percentile``/``median`` aggregates keep every distinct value of
a group in one aggregation buffer. ``exact_quantiles`` instead counts rows per
(group, value) with map-side partial aggregation, so ties collapse to one row,
cuts the distinct values of each large group at splitters taken from a mergeable
sketch of them (so slices hold about equally many, wherever the values lie), adds
up the counts of whole slices (at most ``SLICES`` rows per group), and sorts only the
slices that hold a wanted rank; the linear interpolation (the ``quantile_cont`` /
pandas default) is a last aggregate. The plan is lazy: nothing runs and nothing is
written before the query does.

``global_ranks`` and ``ranks_within_groups`` number the rows themselves by a
range-partitioned sort. ``approx_quantiles`` is the one-pass alternative
(``percentile_approx``, a bounded sketch per group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.plans.joins import materialize, with_scalars


def global_ranks(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Adds ``_grank``: the 0-based position of each row in ``order`` over the whole frame.

    ``repartitionByRange`` spreads the sort over all tasks (a group holding a
    third of the rows is cut into many ranges); each row gets (partition id,
    position) in the same projection, the result is written to the shared
    folder so retries cannot reassign them, and a one-row-per-partition table
    of running counts gives each partition's offset.
    """
    # without an explicit count AQE may coalesce the range partitions; it only
    # merges adjacent ranges in order, so the global order is kept
    rp = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranked = (rp.sortWithinPartitions(*order)
              .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    ranked = materialize(ranked, "ranked")
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    # one row per partition; the running sum over this small table needs no keys
    offsets = counts.select(
        "_pid", (F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off")).fillna(0, ["_off"])
    return (ranked.join(F.broadcast(offsets), "_pid").withColumn("_grank", F.col("_off") + pos)
            .drop("_pid", "_mid", "_off"))


def ranks_within_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                        partitions: int | None = None) -> DataFrame:
    """Adds ``_rank``: 0-based position of each row inside its ``keys`` group in ``order``."""
    g = global_ranks(df, [*keys, *order], partitions)
    starts = g.groupBy(*keys).agg(F.min("_grank").alias("_start"))
    return (g.join(starts, list(keys))
            .withColumn("_rank", F.col("_grank") - F.col("_start")).drop("_grank", "_start"))


#: Slices of a large group's distinct values; a wanted slice is sorted in one task.
SLICES = 1024
#: Groups of fewer distinct values are one slice.
SMALL_GROUP = 4096


def _attached(rows: DataFrame, per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one row of ``per`` of each row's group, NULL groups included."""
    if not keys:
        return with_scalars(rows, per)
    other = per.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.join(other, same).drop(*[f"{k}_" for k in keys])


def sliced_values(counts: DataFrame, value: str, count: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``_n`` (rows of the group) and ``_s``, the slice of a distinct value in its group: the number of
    splitters that are not above it."""
    cuts = F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 8 * SLICES)
    few = F.array().cast("array<double>")
    per = counts.groupBy(*keys).agg(F.sum(count).alias("_n"), F.count(F.lit(1)).alias("_d"), cuts.alias("_cuts"))
    # the last element of a slice's run is its cut; equal cuts are one
    per = per.select(*keys, "_n", F.when(F.col("_d") > SMALL_GROUP, F.array_distinct("_cuts")).otherwise(few).alias("_cuts"))
    steps = F.array(*[F.lit(1 << i) for i in range(SLICES.bit_length() - 1, -1, -1)])

    def halved(at: Column, step: Column) -> Column:
        """A step of the binary search: on by ``step`` if the cut there is not above the value."""
        cut = F.try_element_at(F.col("_cuts"), at + step)
        return F.when(F.coalesce(cut <= F.col(value), F.lit(False)), at + step).otherwise(at)

    whole = _attached(counts, per, keys)
    return whole.withColumn("_s", F.when(F.size("_cuts") == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), halved))).drop("_cuts")


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """One row per group: ``value`` at each quantile (linear interpolation), NULLs ignored.

    NULL is a group of its own; without ``by`` the result is one row (NULLs for an empty frame).
    """
    by, keys = list(by), [f"_k{n}" for n in range(len(by))]
    names = list(names or [f"q{int(round(q * 100)):02d}" for q in quantiles])
    base = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    counts = base.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    sliced = sliced_values(counts, "_v", "_c", keys)
    positions = [(F.col("_n") - 1) * F.lit(float(q)) for q in quantiles]

    def holds(start: Column, end: Column) -> Column:
        """Whether the ranks from ``start`` up to ``end`` hold one that is asked for."""
        found = F.lit(False)
        for p in positions:
            for rank in (F.floor(p), F.ceil(p)):
                found = found | ((start <= rank) & (rank < end))
        return found

    # rows below each slice: at most SLICES rows per group in a window; slices without a wanted rank go
    whole = sliced.groupBy(*keys, "_s").agg(F.sum("_c").alias("_in"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_below", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    whole = whole.where(holds(F.col("_below"), F.col("_below") + F.col("_in")))
    wanted = whole.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_s").alias("_s_"), "_below")
    same = F.col("_s") == F.col("_s_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    inside = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(wanted, same).withColumn("_to", F.col("_below") + F.sum("_c").over(inside))
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_c"))

    def at(position: Column) -> Column:
        """The value at a 0-based position of the group."""
        return F.max(F.when((F.col("_from") <= position) & (position < F.col("_to")), F.col("_v")))

    picked = []
    for n, position in enumerate(positions):
        picked += [at(F.floor(position)).alias(f"_a{n}"), at(F.ceil(position)).alias(f"_b{n}"), F.max(position - F.floor(position)).alias(f"_f{n}")]
    out = ranked.groupBy(*keys).agg(*picked)
    values = [(F.col(f"_a{n}") + (F.col(f"_b{n}") - F.col(f"_a{n}")) * F.col(f"_f{n}")).alias(name) for n, name in enumerate(names)]
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *values)


def approx_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = (),
                     accuracy: int = 10000, names: Sequence[str] | None = None) -> DataFrame:
    names = list(names or [f"q{int(round(q * 100)):02d}" for q in quantiles])
    pa = F.percentile_approx(F.col(value).cast("double"), list(quantiles), accuracy)
    g = df.groupBy(*by).agg(pa.alias("_qs")) if by else df.agg(pa.alias("_qs"))
    return g.select(*by, *[F.col("_qs")[i].alias(n) for i, n in enumerate(names)])
