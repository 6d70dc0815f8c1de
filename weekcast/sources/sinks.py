"""Writers for the retail tables.

* ``append``            append rows (Spark partitions are the write chunks)
* ``conform_to_schema`` select the declared columns in order; a missing column becomes
                        NULL (a missing boolean becomes false), every column is cast
                        to its declared type
* ``replace``           replace the table's contents (overwrite)
* ``append_unique``     append under a UNIQUE key: rows whose key already exists, and
                        further copies of a key in the batch, are rejected instead; a Bloom
                        filter a batch tells which parts of the table to look into
* ``export_csv``        CSV with header
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.session import scratch_path


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def conform_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            src = F.col(f.name)
            if isinstance(f.dataType, T.BooleanType):
                # numeric 0/1 and NaN behave like the original's astype(bool): NaN is true
                t = dict(df.dtypes)[f.name]
                if t in ("double", "float"):
                    src = F.when(F.isnan(src), F.lit(True)).otherwise(src != 0)
            cols.append(src.cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.lit(False).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
        df.schema
        return df
    except AnalysisException:
        return None


def split_unique(new: DataFrame, existing: DataFrame | None, keys: Sequence[str]):
    """(accepted, rejected) rows of ``new`` under a UNIQUE key on ``keys``; together they are ``new``.

    A key that ``existing`` holds is rejected. Of the rows that repeat a key inside
    ``new`` one is accepted (the least by its other columns), the others are
    rejected. A row with a NULL in its key is accepted, as SQL's UNIQUE does.

    The decision is made per key on a partial aggregate and brought back by row
    number, so the copies of a frequent key never meet in one task. ``new`` is read
    twice and must give the same rows in the same partitions (a scan does).
    """
    keys = list(keys)
    rows = new.withColumn("_row", F.monotonically_increasing_id())
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    others = [F.col(c) for c in new.columns if c not in keys]
    first = rows.where(complete).groupBy(*keys).agg(F.min(F.struct(*others, F.col("_row"))).alias("_first"))
    if existing is not None:
        first = first.join(existing.select(*keys), keys, "left_anti")
    first = first.select(F.col("_first._row").alias("_row"), F.lit(True).alias("_taken"))
    tagged = rows.join(first, "_row", "left").withColumn("_ok", F.coalesce("_taken", ~complete))
    accepted = tagged.where("_ok").select(*new.columns)
    rejected = tagged.where("NOT _ok").select(*new.columns)
    return accepted, rejected


#: Bits of a batch's key filter for each of its rows, and places of a key in it: about 1 foreign key in 400 seems held.
FILTER_BITS, FILTER_PLACES = 16, 4


def _month(date_key: str | None):
    return F.date_format(date_key, "'m'yyyy-MM") if date_key is not None else F.lit("all")


def _places(keys: Sequence[str], size) -> list:
    """The bits of a key in a filter of ``size`` bits (a power of two), by double hashing."""
    text = [F.col(k).cast("string") for k in keys]
    first, step = F.xxhash64(*text, F.lit(1)), F.xxhash64(*text, F.lit(2)).bitwiseOR(F.lit(1))
    # 32-bit halves keep the sum within a long
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    return [(low(first) + F.lit(j) * low(step)) % size for j in range(FILTER_PLACES)]


def key_filter(rows: DataFrame, keys: Sequence[str], date_key: str | None = None) -> DataFrame:
    """A Bloom filter of the rows' keys for each month: ``_month``, ``size`` (bits), ``word`` and ``bits``."""
    size = 1 << max(10, (rows.count() * FILTER_BITS).bit_length())
    bits = rows.select(_month(date_key).alias("_month"), F.explode(F.array(*_places(keys, F.lit(size)))).alias("bit"))
    set_ = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    words = bits.groupBy("_month", F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(set_).alias("bits"))
    return words.select("_month", F.lit(size).cast("long").alias("size"), "word", "bits")


def held_parts(new: DataFrame, filters: DataFrame, keys: Sequence[str], date_key: str | None = None) -> list[tuple[str, str]]:
    """The (batch, month) parts of the table that may hold a key of ``new``, by their filters."""
    sizes = [r["size"] for r in filters.select("size").distinct().collect()]  # powers of two: a few dozen at most
    if not sizes:
        return []
    probes = [F.struct(F.lit(n).alias("size"), F.floor(p / 64).alias("word"), (p % 64).cast("int").alias("at")) for n in sizes for p in _places(keys, F.lit(n))]
    text = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    asked = new.select(F.xxhash64(*text).alias("key"), _month(date_key).alias("_month"), F.explode(F.array(*probes)).alias("p")).select("key", "_month", "p.*").distinct()
    hit = asked.join(filters, ["_month", "size", "word"]).where("(shiftright(bits, at) & 1) = 1")
    # a key with two places on one bit has fewer than FILTER_PLACES distinct ones
    wanted = asked.groupBy("key", "_month", "size").agg(F.count("*").alias("wanted"))
    found = hit.groupBy("key", "_month", "size", "_batch").agg(F.count("*").alias("found")).join(wanted, ["key", "_month", "size"])
    parts = found.where("found = wanted").select(F.col("_batch").cast("string").alias("_batch"), "_month").distinct()
    return [tuple(r) for r in parts.collect()]


def existing_keys(new: DataFrame, path: str, keys: Sequence[str], date_key: str | None, batch: str) -> DataFrame | None:
    """The rows of the table's other batches that may hold a key of ``new``; None if there are none.

    The batches' key filters are read first. Parts of the table that hold none of the keys by their filters
    are not read; batches without filters are, in the months between the first and the last date of ``new``.
    """
    spark = new.sparkSession
    existing, filters = _stored(spark, path), _stored(spark, f"{path}.filters")
    if existing is None:
        return None
    if "_batch" not in existing.columns:
        return existing
    name = F.col("_batch").cast("string")
    existing = existing.where(name != batch)
    if date_key is not None and "_month" in existing.columns:
        lo, hi = new.agg(F.min(date_key), F.max(date_key)).first()
        if lo is not None:
            existing = existing.where(F.col("_month").between(f"m{lo:%Y-%m}", f"m{hi:%Y-%m}"))
    if filters is None:
        return existing
    parts = [p for p in held_parts(new, filters.where(name != batch), keys, date_key) if p[0] != batch]
    known = _batches(spark, f"{path}.filters")
    wanted = ~name.isin(*known) if known else F.lit(True)
    for of in sorted({b for b, _ in parts}):
        held = name == of
        if date_key is not None and "_month" in existing.columns:
            held = held & F.col("_month").isin(*sorted(m for b, m in parts if b == of and m is not None))
        wanted = wanted | held
    unknown = _batches(spark, path) - known - {batch}
    return existing.where(wanted) if parts or unknown else None


def _batches(spark: SparkSession, path: str) -> set[str]:
    """The batches of a table, by the names of its folders (what a scan of it lists too)."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [e.getPath().getName() for e in fs.listStatus(top)] if fs.exists(top) else []
    return {n.removeprefix("_batch=") for n in names if n.startswith("_batch=")}


def append_unique(new: DataFrame, path: str, keys: Sequence[str], date_key: str | None = None,
                  rejects: str | None = None, batch: str | None = None) -> None:
    """Append the accepted rows of ``new`` to the table at ``path`` and the others to ``rejects``.

    The table is partitioned by ``_batch`` and, with ``date_key``, by ``_month``. Every batch
    also leaves a Bloom filter of its keys beside the table (``<path>.filters``), written before its rows, so only
    the parts that may hold a key of the new batch are read to look for its keys: a first delivery reads
    none. Every batch overwrites the partition of its own name and is decided against the others, so a batch
    that is delivered again changes neither table. One writer at a time: two at once could both accept a key.
    Read the table with ``scan_unique``.
    """
    spark = new.sparkSession
    batch = batch if batch is not None else f"b{uuid.uuid4().hex}"
    staged = scratch_path(spark, f"unique-{uuid.uuid4().hex}")
    new.write.parquet(staged)
    new = spark.read.schema(new.schema).parquet(staged)
    existing = existing_keys(new, path, keys, date_key, batch)
    accepted, rejected = split_unique(new, existing, keys)
    if date_key is not None:
        accepted = accepted.withColumn("_month", _month(date_key))
    key_filter(new, keys, date_key).write.mode("overwrite").parquet(f"{path}.filters/_batch={batch}")
    w = accepted.write.mode("overwrite")
    (w.partitionBy("_month") if date_key is not None else w).parquet(f"{path}/_batch={batch}")
    if rejects is not None:
        rejected.write.mode("overwrite").parquet(f"{rejects}/_batch={batch}")


def scan_unique(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``append_unique`` wrote, without its partition columns."""
    df = spark.read.parquet(path)
    return df.drop("_batch", "_month")


def export_csv(df: DataFrame, path: str, line_sep: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    if line_sep:
        w = w.option("lineSep", line_sep)
    w.csv(path)
