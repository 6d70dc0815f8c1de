"""Fuzzy line deduplication: MinHash of character shingles, banding, exact verification, union-find.

Lines are compared in lower case with white space runs as one space. Two lines are linked if the
Jaccard similarity of their character shingles (``SHINGLE`` characters) is at least ``THRESHOLD``;
connected lines are one component, of which one line stays in the whole collection: the first one in
the document with the least id. Equal lines are one node (a 64-bit fingerprint), so copies cost one
sketch per task and a count.

The text is read three times and never carried along with the sketches; only candidate lines' texts
are shuffled, behind a fixed-size filter, and documents once, to meet their decisions. Lines whose numbers
of distinct shingles differ by more than the threshold allows are no candidates. Similarity is counted on the
shingles' hashes, of which 44 bits tell those of a pair of lines apart: two different shingles of
one pair are taken for equal with odds of 1 in 2**44.

Defined cases: a line of fewer characters than a shingle is one shingle; blank lines take no part
and stay; a null text stays null; rows with a null id take no part and stay as they are; rows that
repeat an id are decided as one document (each keeps the lines that the id keeps); a document all of
whose lines are kept elsewhere ends up with an empty text; an empty table gives an empty result;
other columns come through as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import linking
from .common import dropped, mix, powers, released, slices, written
from .sketches import bands, minhash, one_permutation

SHINGLE = 7
THRESHOLD = 0.8
#: Registers of a sketch and registers per band: lines of similarity 0.8 share none of the 24 bands with a
#: chance of (1 - 0.8**5)**24, 7 in 100,000. Unlike lines of one language share some shingles: five rows
#: keep their chance collisions rare.
REGISTERS, BAND_ROWS = 120, 5
#: Bytes of lines that are sketched at a time (small enough for a processor's cache), and characters hashed at a time.
CACHE_BYTES, CHUNK = 1 << 16, 1 << 16
#: Lines that a task remembers, so that copies are sketched once (saves work only).
REMEMBERED = 200_000

_FACTOR = np.uint64(0x9FB21C651E98DF25)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRINT_BITS, _OTHER_BITS, _PRINT_MASK = np.uint64(44), np.uint64(20), np.uint64((1 << 44) - 1)


#: Characters other than the space and the new line that ``str.split`` takes for white space.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def line_key(line: str) -> str:
    return " ".join(line.lower().split())


def line_keys(text: str) -> list[str]:
    """The keys of all lines of a text, blank ones empty."""
    lines = text.lower().split("\n")
    if "  " in text or any(c in text for c in _SPACES):
        return [" ".join(x.split()) for x in lines]
    return [x.strip(" ") for x in lines]


def fingerprint(key: str) -> int:
    return int.from_bytes(blake2b(key.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shingle_sets(keys: list[str], prints: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the given normalised lines, none of them empty, as numbers of lines (rising) and 44-bit hashes.

    A shingle's hash is that of its characters; a line of fewer characters has one, made from its fingerprint."""
    sizes = np.array([len(k) for k in keys])
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(keys).encode("utf-32-le", errors="surrogatepass"), np.uint32)
    windows = len(codes) - SHINGLE + 1
    keep = np.ones(max(windows, 0), bool)  # windows that don't reach into the next line
    over = (ends[:, None] - np.arange(1, SHINGLE)).ravel()
    keep[over[(over >= 0) & (over < windows)]] = False
    found = []
    for start in range(0, max(windows, 0), CHUNK):
        part = codes[start : start + CHUNK + SHINGLE - 1]
        n = len(part) - SHINGLE + 1
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * powers(_BASE, len(part))[: len(part)], out=sums[1:])
        hashes = sums[SHINGLE:] - sums[:-SHINGLE]
        hashes *= powers(_INVERSE, len(part))[:n]
        hashes ^= hashes >> np.uint64(31)
        hashes *= _FACTOR
        hashes >>= _OTHER_BITS
        first, last = np.searchsorted(ends, [start, start + n - 1], side="right")
        edges = np.clip(ends[first : last + 1], start, start + n)
        line = np.arange(first, last + 1, dtype=np.uint64) << _PRINT_BITS
        hashes |= np.repeat(line, np.diff(edges, prepend=start))
        found.append(hashes[keep[start : start + n]])
    short = np.flatnonzero(sizes < SHINGLE)
    found.append((short.astype(np.uint64) << _PRINT_BITS) | (mix(np.array(prints, np.int64)[short].view(np.uint64)) >> _OTHER_BITS))
    both = np.sort(np.concatenate(found))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return (both >> _PRINT_BITS).astype(np.int64), both & _PRINT_MASK


def sketched(keys: list[str], prints: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bands of the given normalised lines, none of them empty, and the lines' numbers of distinct shingles."""
    lines, shingles = shingle_sets(keys, prints)
    sizes = np.bincount(lines, minlength=len(keys))
    registers = np.empty((len(keys), REGISTERS), np.uint64)
    large = sizes >= REGISTERS
    for chosen, sketch in ((large, one_permutation), (~large, minhash)):
        if chosen.any():
            own = chosen[lines]
            place = np.cumsum(chosen) - 1
            registers[chosen] = sketch(place[lines[own]], shingles[own], int(chosen.sum()), REGISTERS)
    return bands(registers, BAND_ROWS), sizes


def jaccard(a: str, b: str) -> float:
    x = {a[i : i + SHINGLE] for i in range(max(1, len(a) - SHINGLE + 1))}
    y = {b[i : i + SHINGLE] for i in range(max(1, len(b) - SHINGLE + 1))}
    shared = len(x & y)
    return shared / (len(x) + len(y) - shared)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, ``node``, ``bands`` and ``size`` (distinct shingles) of every line that isn't blank. A task gives
    the bands and size of a line it remembers only once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", CACHE_BYTES):
                docs_, nodes, fresh, keys, prints = [], [], [], [], []
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                    for key in line_keys(text):
                        if key:
                            node = fingerprint(key)
                            docs_.append(doc)
                            nodes.append(node)
                            fresh.append(node not in seen)
                            if fresh[-1]:
                                seen.add(node)
                                keys.append(key)
                                prints.append(node)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not nodes:
                    continue
                values, sizes = sketched(keys, prints) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
                known = np.array(fresh)
                offsets = np.concatenate(([0], np.cumsum(known))).astype(np.int32) * (REGISTERS // BAND_ROWS)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=pa.array(~known))
                size = np.zeros(len(known), np.int32)
                size[known] = sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(nodes, pa.int64()), lists, pa.array(size, mask=~known)], ["doc", "node", "bands", "size"]
                )

    return rows.mapInArrow(run, "doc long, node long, bands array<long>, size int")


def _line_texts(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """``node`` and ``line`` of the given nodes; a fixed-size filter prunes other lines before the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(linking.filter_of(nodes, "node"))
    rows = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys = [k for t in part.column("text").to_pylist() for k in line_keys(t) if k]
                if not keys:
                    continue
                prints = np.array([fingerprint(k) for k in keys], np.int64)
                out = {}
                for at in np.flatnonzero(linking.may_hold(bits.value, prints)).tolist():
                    node = int(prints[at])
                    if node not in seen:
                        seen.add(node)
                        out[node] = keys[at]
                if len(seen) > REMEMBERED:
                    seen.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.string())], ["node", "line"])

    return rows.mapInArrow(run, "node long, line string").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def shared_shingles(lines: np.ndarray, shingles: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (a, b) of line numbers: the shingles that both have, and those that either has."""
    starts, sizes = np.searchsorted(lines, np.arange(n)), np.bincount(lines, minlength=n)
    whole, pairs = np.column_stack((a, b)).ravel(), np.arange(2 * len(a)) // 2
    count = sizes[whole]
    first = np.cumsum(count) - count
    at = np.arange(count.sum()) - np.repeat(first - starts[whole], count)
    both = np.sort((np.repeat(pairs, count).astype(np.uint64) << _PRINT_BITS) | shingles[at])
    twice = both[1:][both[1:] == both[:-1]] >> _PRINT_BITS
    shared = np.bincount(twice.astype(np.int64), minlength=len(a))
    return shared, sizes[a] + sizes[b] - shared


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "line_a", CACHE_BYTES):
            place: dict[str, int] = {}
            a, b = (np.array([place.setdefault(x, len(place)) for x in part.column(c).to_pylist()]) for c in ("line_a", "line_b"))
            keys = list(place)
            lines, shingles = shingle_sets(keys, [fingerprint(k) if len(k) < SHINGLE else 0 for k in keys])
            shared, either = shared_shingles(lines, shingles, a, b, len(keys))
            yield part.select(["a", "b"]).filter(pa.array(shared / either >= THRESHOLD))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line's distinct shingles, and the share that each has of them."""
    for batch in batches:
        for part in slices(batch, "line", CACHE_BYTES):
            nodes = part.column("node").to_numpy()
            lines, shingles = shingle_sets(part.column("line").to_pylist(), nodes.tolist())
            sizes = np.bincount(lines, minlength=len(nodes))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (shingles.view(np.int64), (1 / sizes)[lines])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), *lists], ["node", "elements", "shares"])


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every line that occurs again, alike or nearly: ``doc``, ``node``, ``component`` and ``keeper``
    (the document in which the component's line stays)."""
    lines = written(line_table(docs, id_col, text_col), "lines")
    members = linking.shared_buckets(lines.withColumn("peak", 1 / F.col("size")), sizes=("size", "peak"))
    texts = written(_line_texts(docs, members.select("node").distinct(), text_col), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("line_a"))
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("line_b"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        return both.mapInArrow(_similar, "a long, b long")

    def elements(nodes: DataFrame) -> DataFrame:
        return texts.join(nodes, "node", "left_semi").mapInArrow(_elements, "node long, elements array<long>, shares array<double>")

    links = linking.linked(members, verify, THRESHOLD, elements)
    named = linking.components(links)
    uses = lines.groupBy("node").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    uses = uses.join(named, "node", "left").withColumn("component", F.coalesce("class_id", "node"))
    uses = written(uses.where("class_id IS NOT NULL OR n > 1").select("node", "n", "first", "component"), "line-uses")
    keepers = written(uses.groupBy("component").agg(F.min("first").alias("keeper")), "line-keepers")
    nodes = written(uses.join(keepers, "component").select("node", "component", "keeper"), "line-nodes")
    found = written(lines.select("doc", "node").join(nodes, "node").distinct(), "line-decisions")
    for old in (lines, members, texts, links, named, uses, keepers, nodes):
        dropped(old)
    return found


def _without(text: str | None, repeats: dict[int, tuple[int, bool]]) -> tuple[str | None, int, int]:
    """The text without the lines that are kept elsewhere; its lines (blank ones not counted) and those dropped."""
    if text is None:
        return None, 0, 0
    if not repeats:
        return text, sum(not x.isspace() for x in text.split("\n") if x), 0
    kept, told, n, gone = [], set(), 0, 0
    lines, keys = text.split("\n"), line_keys(text)
    for line, key in zip(lines, keys):
        if key:
            n += 1
            decided = repeats.get(fingerprint(key))
            if decided is not None:
                component, mine = decided
                if not mine or component in told:
                    gone += 1
                    continue
                told.add(component)
        kept.append(line)
    return ("\n".join(kept) if gone else text), n, gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The rows of ``docs`` with one line kept per component, and of each row how many lines there were and
    were dropped, under the names ``counts`` (unless the rows have such columns)."""
    found = decisions(docs, id_col, text_col)
    per_doc = found.groupBy("doc").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("component").alias("components"), F.collect_list(F.col("keeper") == F.col("doc")).alias("mine")
    )
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(per_doc, "doc", "left").select("row", "text", "nodes", "components", "mine")
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, nodes, components, mine in zip(*(part.column(c).to_pylist() for c in ("text", "nodes", "components", "mine"))):
                    out.append(_without(text, dict(zip(nodes, zip(components, mine))) if nodes else {}))
                texts, n, gone = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(gone, pa.int32())], ["row", "text", "n_lines", "n_dropped"]
                )

    done = rows.mapInArrow(run, f"row {row_type}, text string, n_lines int, n_dropped int")
    columns = [F.col("text").alias(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*columns, *[F.col(c).alias(name) for c, name in zip(("n_lines", "n_dropped"), counts) if name not in docs.columns])
