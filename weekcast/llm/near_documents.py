"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and verification.

A document's shingles are its runs of ``SHINGLE`` words (lower case, split at white space), weighted
by how often they occur. Two documents are linked if the probability Jaccard similarity of their
weighted shingles is at least ``THRESHOLD``; documents connected by links are one class, named by its
least id. Sketches are made in one scan, equal texts are one node, candidates share a band, and every
candidate pair that matters for the classes is verified exactly (see ``linking``).

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and blank texts have
no shingles and are each a class of their own; rows with a null id have a null class and take no
part; rows that repeat an id are one document, whose texts count together; an empty table gives an
empty result; other columns are ignored (``keep_one`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import linking
from .common import dropped, normalised, released, shingle_hashes, slices, word_hashes, written
from .sketches import bands, prob_minhash

SHINGLE = 5
THRESHOLD = 0.8
#: Registers of a sketch and registers per band: two documents of similarity 0.8 share none of the 32 bands
#: with a chance of (1 - 0.8**6)**32, about 6 in 100,000; at 0.3, as of documents with a passage in
#: common, they share one with a chance of 2 in a hundred.
REGISTERS, BAND_ROWS = 192, 6
#: Texts that a task remembers, so that copies are sketched once (saves work only).
REMEMBERED = 50_000


def weighted_shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, sorted, and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(normalised(text).encode()), size), return_counts=True)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over shared elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    xs, ys = x[i].astype(float), y[j].astype(float)
    order = np.argsort(xs / ys, kind="stable")
    xs, ys = xs[order], ys[order]
    ratio = xs / ys
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    at = np.searchsorted(ratio, ratio, side="left")  # from here on x_j / x_i is the larger one
    x_from = np.concatenate((np.cumsum(xs[::-1])[::-1], [0.0]))
    y_to = np.concatenate(([0.0], np.cumsum(ys)))
    return float((1.0 / ((only_x + x_from[at]) / xs + (only_y + y_to[at]) / ys)).sum())


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``text_key`` (16 bytes that equal texts share; null without words), ``bands``, ``size`` (distinct
    shingles) and ``peak`` (the largest share of one) of every row with an id. A task gives the bands and
    sizes of a text it remembers only once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, fresh, sets, hashes, counts = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    words = normalised(text).encode()
                    key = md5(words).digest() if words else None
                    keys.append(key)
                    fresh.append(key is not None and key not in seen)
                    if fresh[-1]:
                        if len(seen) < REMEMBERED:
                            seen.add(key)
                        found, n = np.unique(shingle_hashes(word_hashes(words), SHINGLE), return_counts=True)
                        sets.append(np.full(len(found), len(sets)))
                        hashes.append(found)
                        counts.append(n)
                offsets = np.concatenate(([0], np.cumsum(fresh))).astype(np.int32) * (REGISTERS // BAND_ROWS)
                values = np.empty(0, np.int64)
                if sets:
                    registers = prob_minhash(np.concatenate(sets), np.concatenate(hashes), np.concatenate(counts), len(sets), REGISTERS)
                    values = bands(registers, BAND_ROWS).ravel()
                known = np.array(fresh, bool)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~known))
                measures = []
                for measured in ([len(n) for n in counts], [n.max() / n.sum() for n in counts]):
                    column = np.zeros(len(fresh), np.float32)
                    column[known] = measured
                    measures.append(pa.array(column, mask=~known))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.binary()), lists, *measures], ["id", "text_key", "bands", "size", "peak"])

    return rows.mapInArrow(run, "id long, text_key binary, bands array<long>, size float, peak float")


def _weights(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The weighted shingles of the documents that may be among the nodes (a fixed-size filter prunes the rest)."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(linking.filter_of(nodes.select(F.xxhash64("node").alias("key")), "key"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long")).alias("key"), F.col(text_col).alias("text"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = linking.may_hold(bits.value, batch.column("key").to_numpy(zero_copy_only=False))
            for part in slices(batch.filter(pa.array(likely)), "text"):
                found = [weighted_shingles(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))],
                    ["node", "hashes", "counts"],
                )

    return rows.mapInArrow(run, "node long, hashes array<long>, counts array<int>").join(nodes, "node", "left_semi").distinct()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("hashes_a", "counts_a", "hashes_b", "counts_b")]
        scores = []
        for n in range(batch.num_rows):
            a, x, b, y = (np.asarray(c[n].values) for c in columns)
            scores.append(probability_jaccard(a.view(np.uint64), x, b.view(np.uint64), y))
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())], ["a", "b", "similarity"])
        yield out.filter(pa.array([s >= THRESHOLD for s in scores], pa.bool_()))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``class_id`` of every row: the least id of the documents connected by similarity."""
    made = written(sketches(docs, id_col, text_col), "doc-sketches")
    known = made.where("text_key IS NOT NULL")
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("bands", "size", "peak")]
    texts = written(known.groupBy("text_key").agg(F.min("id").alias("node"), *firsts), "doc-texts")
    members = linking.shared_buckets(texts, sizes=("size", "peak"))
    weights = written(_weights(docs, members.select("node").distinct(), id_col, text_col), "doc-weights")

    def verify(pairs: DataFrame) -> DataFrame:
        left = weights.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a"), F.col("counts").alias("counts_a"))
        right = weights.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b"), F.col("counts").alias("counts_b"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        return both.mapInArrow(_similar, "a long, b long, similarity double").select("a", "b").distinct()

    def elements(nodes: DataFrame) -> DataFrame:
        """The shingles of documents; a similarity of s needs s of either's mass in common."""
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
        rows = weights.join(nodes, "node", "left_semi").withColumn("total", total)
        return rows.select("node", F.col("hashes").alias("elements"), F.transform("counts", lambda n: n / F.col("total")).alias("shares"))

    links = linking.linked(members, verify, THRESHOLD, elements)
    # an id that comes with several texts ties them together
    of_text = known.select("id", "text_key").join(texts.select("text_key", "node"), "text_key")
    tied = of_text.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    named = linking.components(links.unionByName(tied.select("a", "b")))
    of_text = texts.select("text_key", "node").join(named, "node", "left").select("text_key", F.coalesce("class_id", "node").alias("class_id"))
    of_text = written(of_text, "doc-classes")
    for old in (texts, members, weights, links, named):
        dropped(old)
    # blank texts have no key and go past the join: as nulls they would all meet in one task
    found = known.select("id", "text_key").join(of_text, "text_key").select("id", "class_id")
    found = found.unionByName(made.where("text_key IS NULL").select("id", F.col("id").alias("class_id")))
    kind = docs.schema[id_col].dataType
    found = found.select(F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"))
    none = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.lit(None).cast(kind).alias("class_id"))
    return found.unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every class the document with the least id stays,
    once. Documents without words or without an id all stay."""
    stays = classes(docs, id_col, text_col).where(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("_stays")).distinct()
    stays = written(stays, "doc-stays")
    blank = F.coalesce(F.regexp_replace(F.trim(F.col(text_col)), r"\s+", ""), F.lit("")) == ""
    nameless = docs.where(F.col(id_col).isNull())
    rows = docs.where(F.col(id_col).isNotNull()).join(stays, F.col(id_col) == F.col("_stays"), "left_semi")
    turn = Window.partitionBy(id_col).orderBy(blank, F.xxhash64(*[F.col(c) for c in docs.columns]))
    return rows.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn").unionByName(nameless)
