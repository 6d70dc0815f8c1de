"""Text search over a trigram index: the rows that a regular expression can match, then the expression itself.

``build`` writes the rows with a number and, for every run of three characters (ASCII letters as small ones) that some
column of a row holds as text, the places of the rows in blocks of row numbers. ``search`` takes from the expression the
runs of characters that every match must hold, reads the postings of the rarest of their trigrams, and
runs ``explore.text_search`` on the rows that have them all. An expression from which no
such trigram follows (alternatives, groups, short words) is looked for in all rows. Results are those of the full scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.operators.explore import text_search

GRAM = 3
#: Row numbers of one block (places in it have 16 bits); trigrams of a search that are read; blocks that are named in a scan's filter.
BLOCK, READ_GRAMS, NAMED_BLOCKS = 1 << 15, 4, 1000

#: Bytes of text of which a task makes postings at a time.
SLICE_BYTES = 4 << 20

#: Escapes of one letter: classes, borders and control characters.
_PLAIN_ESCAPES = "dDwWsSbBtnrfhHvVAzZGRae"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_SMALL = str.maketrans(_CAPITALS, _SMALL)


def _shifted(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits)


def _postings(texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigrams of the texts (code points shifted by 42, 21 and 0 bits) with each one's rows: of every distinct
    trigram, rising, its code and the place where its rows end, and all those rows. ``rows`` rise (a row may have several texts)."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", errors="surrogatepass"), np.uint32)
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where((codes >= ord("A")) & (codes <= ord("Z")), codes + 32, codes)
    # characters are numbered, so that a trigram and the number of its row have room in 64 bits
    used = np.zeros(1 << 21, bool)
    used[codes] = True
    letters = np.flatnonzero(used).astype(np.uint64)
    number = np.zeros(1 << 21, np.uint64)
    number[letters.view(np.int64)] = np.arange(len(letters), dtype=np.uint64)
    distinct, place = np.unique(rows, return_inverse=True)
    wide, low = max(1, (len(letters) - 1).bit_length()), (len(distinct) - 1).bit_length()
    if GRAM * wide + low > 64:  # never of a single row: there are fewer than 2**21 characters
        half = int(np.searchsorted(rows, distinct[len(distinct) // 2]))
        parts = [_postings(texts[:half], rows[:half]), _postings(texts[half:], rows[half:])]
        code = np.concatenate([np.repeat(c, np.diff(e, prepend=0)) for c, e, _ in parts])
        held = np.concatenate([r for _, _, r in parts])
        order = np.argsort(code, kind="stable")
        code, held = code[order], held[order]
        ends = np.flatnonzero(np.concatenate((code[1:] != code[:-1], [True]))[: len(code)]) + 1
        return code[ends - 1], ends, held
    codes = number[codes]
    key = codes[:n].copy()
    for j in range(1, GRAM):
        key = _shifted(key, wide) | codes[j : n + j]
    key = _shifted(key, low) | np.repeat(place.astype(np.uint64), lengths)[:n]
    inside = np.ones(n, bool)  # windows that don't reach into the next text
    over = (np.cumsum(lengths)[:, None] - np.arange(1, GRAM)).ravel()
    inside[over[(over >= 0) & (over < n)]] = False
    key = np.sort(key[inside])
    key = key[np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]]
    held = distinct[(key & np.uint64((1 << low) - 1)).view(np.int64)]
    gram = key >> np.uint64(low)
    ends = np.flatnonzero(np.concatenate((gram[1:] != gram[:-1], [True]))[: len(gram)]) + 1
    first, mask = gram[ends - 1], np.uint64((1 << wide) - 1)
    code = np.zeros(len(first), np.uint64)
    for j in range(GRAM):
        code = _shifted(code, 21) | letters[((first >> np.uint64(wide * (GRAM - 1 - j))) & mask).view(np.int64)]
    return code, ends, held


def _strings(codes: np.ndarray) -> list[str]:
    points = np.stack([(codes >> np.uint64(21 * (GRAM - 1 - j))) & np.uint64((1 << 21) - 1) for j in range(GRAM)], 1).astype(np.uint32)
    whole = points.tobytes().decode("utf-32-le", errors="surrogatepass")
    return [whole[i : i + GRAM] for i in range(0, len(whole), GRAM)]


def _posted(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``gram``, ``block``, ``rows`` (places in the block) and ``n``: of every trigram in the columns' texts the rows that hold it, for some thousand
    rows at a time. A row is in one posting of a trigram, whichever and however many of its columns hold it."""
    texts = rows.select("_row", *[F.col(f"`{c}`").cast("string").cast("binary").alias(f"t{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[1:]
            sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            numbers = batch.column("_row").to_numpy()
            ends = np.cumsum(sizes)
            start = 0
            while start < batch.num_rows:
                # a block at a time, and of it about SLICE_BYTES of text, one row at least
                stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right"))
                other = np.flatnonzero(numbers[start:] // BLOCK != numbers[start] // BLOCK)
                stop = min(max(stop, start + 1), start + int(other[0]) if len(other) else batch.num_rows)
                found, at = [], []
                for i, values in enumerate(zip(*(c.slice(start, stop - start).to_pylist() for c in columns)), start):
                    own = [v.decode(errors="replace") for v in values if v is not None and len(v) >= GRAM]
                    found += own
                    at += [numbers[i]] * len(own)
                block, start = int(numbers[start] // BLOCK), stop
                code, to, held = _postings(found, np.array(at, np.int64))
                if len(code):
                    offsets = pa.array(np.concatenate(([0], to)).astype(np.int32))
                    places = pa.ListArray.from_arrays(offsets, pa.array((held - block * BLOCK).astype(np.int16)))
                    n = np.diff(to, prepend=0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(_strings(code)), pa.array(np.full(len(code), block)), places, pa.array(n)], ["gram", "block", "rows", "n"])

    return texts.mapInArrow(run, "gram string, block long, rows array<short>, n int")


def build(df: DataFrame, path: str, cols: Sequence[str] | None = None) -> None:
    """Writes the rows and the index of their columns (all, if none are named) below ``path``.

    Every task writes the postings of its own rows, ordered by trigram: nothing is shuffled but the counts of the trigrams."""
    cols = list(cols or df.columns)
    # the numbers are written with the rows, so that a repeated task can't give others
    df.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    _posted(rows, cols).sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/postings")
    posts = df.sparkSession.read.parquet(f"{path}/postings")
    posts.groupBy("gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    df.sparkSession.createDataFrame([(c,) for c in cols], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def required_runs(pattern: str) -> list[str]:
    """Runs of characters that every match of the expression holds; none where that is not plain to see."""
    runs, run, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c in "()|":
            return []  # alternatives and groups: any part may be missing
        if c in "?*{":
            run = run[:-1]  # what stands before may be missing
        if c == "\\":
            at += 1
            follows = pattern[at : at + 1]
            if not follows or follows.isalnum() and follows not in _PLAIN_ESCAPES:
                return []  # quotations, characters by number, references: longer than one letter
            if not follows.isalnum():
                run += follows
                at += 1
                continue
        if c == "[":
            end = pattern.find("]", at + 2 + pattern.startswith("[^", at))
            if end < 0 or "[" in pattern[at + 1 : end] or "&&" in pattern[at:end] or "\\" in pattern[at:end]:
                return []
            at = end
        if c == "{":
            end = pattern.find("}", at)
            if end < 0:
                return []
            at = end
        if c in "?*{+\\[.^$":
            runs.append(run)
            run = ""
        else:
            run += c
        at += 1
    return [r for r in [*runs, run] if len(r) >= GRAM]


def required_grams(pattern: str) -> list[str]:
    small = [r.translate(_TO_SMALL) for r in required_runs(pattern)]
    return sorted({r[i : i + GRAM] for r in small for i in range(len(r) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """The numbers of the rows that hold the rarest required trigrams (``_row``); None where none is required."""
    grams = required_grams(pattern)
    if not grams:
        return None
    sizes = {r.gram: r.n for r in spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(grams)).collect()}
    rare = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:READ_GRAMS]
    posts = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(rare))
    # a trigram that no row holds has no postings, so the count is not reached
    held = posts.select("gram", "block", F.explode("rows").alias("place")).select("gram", (F.col("block") * BLOCK + F.col("place")).alias("_row")).groupBy("_row").agg(F.count("gram").alias("n"))
    return held.where(F.col("n") == len(rare)).select("_row")


def search(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The rows where any indexed column, as text, matches ``pattern`` case-insensitively."""
    rows = spark.read.parquet(f"{path}/rows")
    cols = [r.name for r in spark.read.parquet(f"{path}/columns").collect()]
    found = candidates(spark, path, pattern)
    if found is not None:
        blocks = [r.b for r in found.select(F.floor(F.col("_row") / BLOCK).cast("long").alias("b")).distinct().limit(NAMED_BLOCKS + 1).collect()]
        if not blocks:
            rows = rows.where(F.lit(False))
        elif len(blocks) <= NAMED_BLOCKS:  # lets the scan skip files and row groups by their statistics
            rows = rows.where(F.col("_row").between(min(blocks) * BLOCK, max(blocks) * BLOCK + BLOCK - 1))
        rows = rows.join(found, "_row", "left_semi")
    return text_search(rows, pattern, cols).drop("_row")
