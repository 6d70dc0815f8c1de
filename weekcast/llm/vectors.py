"""Approximate nearest neighbours by a permutation index.

A bounded sample of the vectors are pivots. Every vector is represented by the order of its nearest
pivots and posted, with the places of those pivots, in the pivots' inverted files. A query visits the
files of its own nearest pivots, adds up how far each posted vector's places are from its own (the
footrule distance, a pivot missing on one side counting as the place after the last), and the best
share of each chunk by that distance is reranked by the inner product of the original vectors.

Nearness is the largest inner product. Vectors need not have one length: the index works on vectors
extended by one component to equal length (``sqrt(M*M - |x|*|x|)``, M the longest), on which the
order of cosines to a query is that of inner products.

The index is a table written once (every valid vector has a row). It is read in chunks of
``CHUNK_ROWS`` rows, and queries go against all chunks in blocks of ``BLOCK_QUERIES`` (broadcast: at
most that many vectors). Each task keeps the best k of a query over its chunks, Spark merges the tasks.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor
those of another dimension than the most frequent one (the larger if tied); rows with a null id take
no part; of rows that repeat an id the smallest vector counts; equal scores go by the smaller id, also
where the share is cut; fewer than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Pivots (the sample that the index is fitted on, by hash of the id) and pivots kept per vector.
PIVOTS = 1024
PLACES = 64
#: Share of a chunk's rows that is reranked, and the least number.
SHARE = 0.3
LEAST = 500
CHUNK_ROWS = 8192
BLOCK_QUERIES = 8192


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _extended(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest * longest - np.einsum("ij,ij->i", x, x), 0.0))
    return np.hstack([x, rest[:, None]])


def places(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest pivots of each row, nearest first (ties to the earlier pivot)."""
    near = x @ pivots.T
    part = np.sort(np.argpartition(-near, n - 1, axis=1)[:, :n], axis=1)
    order = np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1).astype(np.int16)


class Chunk:
    """The pivot inverted files of some rows of the index, sorted by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, orders: np.ndarray, pivots: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x, orders = ids[by_id], x[by_id], orders[by_id]
        self.n = orders.shape[1]
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.rows, self.place = by_pivot // self.n, (by_pivot % self.n).astype(np.int16)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """What each row saves of the largest footrule distance to a query with these nearest pivots."""
        saved = np.zeros(len(self.ids), np.int32)
        for k, pivot in enumerate(order.tolist()):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            # both missing would cost (n - k) here and (n - place) on the row's side
            saved[self.rows[a:b]] += (2 * self.n - k) - self.place[a:b] - np.abs(self.place[a:b] - np.int16(k))
        return saved

    def nearest(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        saved = self.footrule(order)
        take = max(LEAST, int(np.ceil(share * len(saved))))
        best = np.argsort(-saved, kind="stable")[: take + 1]
        best = np.sort(best[self.ids[best] != query_id][:take])
        scores = np.einsum("ij,j->i", self.x[best], query)
        top = np.lexsort((self.ids[best], -scores))[:k]
        return self.ids[best[top]], scores[top]


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = PIVOTS, n_places: int = PLACES):
    """The written index (id, vector, order) and its pivots; None if no vector is valid."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.col("vector")))
    rows = written(rows.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    dims = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None:
        return None
    dim = dims["dim"]
    rows = rows.where(F.size("vector") == dim)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    longest = float(rows.agg(F.max(norm)).first()[0])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    pivots = _extended(np.array([r["vector"] for r in sample]), longest)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    n = min(n_places, len(pivots))
    fitted = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                orders = places(_extended(_matrix(part.column("vector"), dim), longest), fitted.value, n)
                nested = pa.ListArray.from_arrays(pa.array(np.arange(len(orders) + 1, dtype=np.int32) * n), pa.array(orders.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, nested], ["id", "vector", "order"])

    return written(rows.mapInArrow(run, "id long, vector array<double>, order array<smallint>"), "permutations"), pivots


def search(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    n_pivots: int = PIVOTS, n_places: int = PLACES, share: float = SHARE,
) -> DataFrame:
    """The ``k`` nearest found of every row for which ``queries`` (a condition on ``id``) holds:
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score double"
    made = index(vectors, id_col, vector_col, n_pivots, n_places)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, pivots = made
    dim = pivots.shape[1] - 1
    asked = rows.where(queries)
    n_blocks = max(1, -(-asked.count() // (BLOCK_QUERIES // 2)))
    found = None
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).collect()
        if not mine:
            continue
        sent = spark.sparkContext.broadcast(
            (np.array([r["id"] for r in mine]), np.array([r["vector"] for r in mine]), np.array([r["order"] for r in mine], np.int16))
        )

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, xs, orders = sent.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
            for chunk in _chunks(batches, dim, len(pivots)):
                for j in range(len(ids)):
                    near, scores = chunk.nearest(ids[j], xs[j], orders[j], k, share)
                    near, scores = np.concatenate((best[j][0], near)), np.concatenate((best[j][1], scores))
                    top = np.lexsort((near, -scores))[:k]
                    best[j] = near[top], scores[top]
            sizes = [len(b[0]) for b in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))],
                    ["query_id", "vec_id", "score"],
                )

        part = rows.mapInArrow(run, result)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _chunks(batches: Iterator[pa.RecordBatch], dim: int, n_pivots: int) -> Iterator[Chunk]:
    held, size = [], 0

    def made() -> Chunk:
        whole = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: whole.column(c).chunk(0)
        orders = column("order").flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
        return Chunk(column("id").to_numpy(zero_copy_only=False), _matrix(column("vector"), dim), orders, n_pivots)

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            if size and size + part.num_rows > CHUNK_ROWS:
                yield made()
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield made()
