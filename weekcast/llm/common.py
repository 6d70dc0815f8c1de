"""Helpers shared by the operators: tables, written intermediates, bounded slices, vectorised text hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Text bytes that one vectorised step takes at a time; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written` that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together have about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: What the tasks of one operator keep in their worker for its next task: (owner, key) and the object.
_KEPT: dict[tuple, object] = {}


def kept(owner: str, key: object, make: Callable[[], object]) -> object:
    """The one object that the owner's tasks keep in this worker, made anew for another key."""
    released(owner)
    if (owner, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def released(owner: str | None = None) -> None:
    """Drops what others than ``owner`` have kept in this worker: called where a task needs memory of its own."""
    if any(of != owner for of, _ in _KEPT):
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, near inputs unrelated ones."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64; kept for the lengths that slices usually have."""
    out = _POWERS.get(base)
    if out is None or len(out) <= n:
        out = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n <= SLICE_BYTES:
            _POWERS[base] = out
    return out[: n + 1]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Spans:
    """Runs of marked characters of a text (its code points), and hashes of them."""

    def __init__(self, codes: np.ndarray, marked: np.ndarray):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        n = len(codes)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(mix(codes.astype(np.uint64)) * powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = powers(_INVERSE, n)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of each run, or of the first ``longest`` characters of those that have more."""
        starts, ends = self.starts, self.ends
        if longest is not None:
            starts = starts[ends - starts > longest]
            ends = starts + longest
        tag = (ends - starts).astype(np.uint64) + np.uint64(0 if longest is None else 1 << 40)
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] ^ tag)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word of a text whose words are split by single spaces (no space at the ends)."""
    raw = np.frombuffer(text, np.uint8)
    return Spans(raw, raw != 32).hashes()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; a shorter text is one shingle, an empty one none."""
    if len(words) == 0:
        return words
    k = min(size, len(words))
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out *= _MIX1
        out += words[j : len(words) - k + 1 + j]
    return mix(out)


def normalised(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed; null as empty."""
    return " ".join(text.lower().split()) if text else ""
