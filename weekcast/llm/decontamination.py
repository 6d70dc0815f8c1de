"""Benchmark decontamination by the q-gram lemma.

Every run of ``WINDOW`` characters of a benchmark item is a window (a shorter item is one window). A
window of w characters that occurs in a document with at most k edits shares at least
``w - q + 1 - k * q`` of its q-grams with it, all within k + 1 neighbouring diagonals. So the q-grams
of a document are looked up in an index of the items' q-grams, hits are collected per item in
overlapping bands of diagonals, the window slides over the hits of a band, and places that reach the
bound are verified by a banded alignment; hits that make up a whole window on one diagonal are an
exact occurrence as they are. A document that holds a window within its edit budget is contaminated
by the item.

The benchmark is the stated query set: it goes to the tasks in blocks of at most ``BLOCK_CHARS``
characters (plus one item), each broadcast; documents are never shuffled, every whole text is
searched against every block.

Defined cases: a null or empty text or item matches nothing; an item with fewer characters than a
q-gram is found where a document holds it exactly; rows are judged one by one, so repeated rows, ties and null ids are judged as they
are (``matches`` merges rows that repeat an id); an empty benchmark leaves everything clean; an empty
table gives an empty result; other columns come through ``clean`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, normalised, slices

Q = 10
WINDOW = 64
#: Edits allowed per character of a window; fewer if the bound would fall below ``LEAST_SHARED``.
EDIT_RATE = 1 / 12
LEAST_SHARED = 4
BLOCK_CHARS = 500_000
#: Candidates that one alignment step holds.
STEP = 20_000

_FACTOR = np.uint64(0x9FB21C651E98DF25)
_TABLE_BITS = 22
_FAR = 1 << 20


def edit_budget(size: int) -> int:
    return max(0, min(int(size * EDIT_RATE), (size - Q + 1 - LEAST_SHARED) // Q))


def windows(item: str) -> list[tuple[int, str]]:
    """Start and text of the item's windows, at every start."""
    return [(n, item[n : n + WINDOW]) for n in range(max(len(item) - WINDOW, 0) + 1)] if item else []


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32).astype(np.int64)


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = max(len(codes) - q + 1, 0)
    out = codes[:n].astype(np.uint64)
    for j in range(1, q):
        out *= _FACTOR
        out += codes[j : j + n].view(np.uint64)
    return mix(out)


@dataclass
class Index:
    """The q-grams of some items, and the items' characters."""

    items: list
    codes: np.ndarray  # of all items, one after the other
    offset: np.ndarray  # of each item in them
    length: np.ndarray
    size: np.ndarray  # of each item's windows
    budget: np.ndarray
    table: np.ndarray  # which gram prefixes occur
    grams: np.ndarray  # sorted, distinct
    starts: np.ndarray  # of each gram's postings
    item: np.ndarray
    place: np.ndarray
    short: dict  # length below Q: sorted hashes of the items so long, and their numbers


def build(rows: list[tuple[object, str | None]]) -> Index | None:
    own = [_codes(_text(text)) for _, text in rows]
    if not any(len(c) for c in own):
        return None
    length = np.array([len(c) for c in own])
    size = np.minimum(length, WINDOW)
    hashes = [_grams(c) for c in own]
    item, place = np.repeat(np.arange(len(own)), [len(h) for h in hashes]), np.concatenate([np.arange(len(h)) for h in hashes])
    grams = np.concatenate(hashes)
    order = np.argsort(grams, kind="stable")
    distinct, starts = np.unique(grams[order], return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[distinct >> np.uint64(64 - _TABLE_BITS)] = True
    short = {}
    for q in range(1, Q):
        found = np.flatnonzero(length == q)
        if len(found):
            hashed = np.array([_grams(own[n], q)[0] for n in found])
            order_short = np.argsort(hashed, kind="stable")
            short[q] = (hashed[order_short], found[order_short])
    offset = np.concatenate(([0], np.cumsum(length)[:-1]))
    budget = np.array([edit_budget(s) for s in size.tolist()])
    return Index([i for i, _ in rows], np.concatenate(own), offset, length, size, budget, table, distinct, np.append(starts, len(grams)), item[order], place[order], short)


def _text(text: str | None) -> str:
    return normalised(text.replace("\x00", " ")) if text else ""


def aligned(index: Index, item: np.ndarray, window: np.ndarray, text: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window (its start in the item) against the text from ``start`` on, over ``width`` diagonals, and
    where that alignment ends. NUL in the text separates documents and can't be crossed."""
    n, first, size = len(window), index.offset[item] + window, index.size[item]
    cost = np.zeros((n, width), np.int64)  # an alignment may start on any diagonal of the band
    result, end = np.full(n, _FAR), np.zeros(n, np.int64)
    steps = np.arange(width)
    for i in range(int(size.max())):
        chars = text[start[:, None] + i + steps]
        wall = np.where(chars == 0, _FAR, 0)
        new = cost + (chars != index.codes[np.minimum(first + i, len(index.codes) - 1)][:, None]) + wall
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        for d in range(1, width):
            np.minimum(new[:, d], new[:, d - 1] + 1 + wall[:, d], out=new[:, d])
        cost = new
        done = size == i + 1
        if done.any():
            best = cost[done].argmin(axis=1)
            result[done] = cost[done, best]
            end[done] = start[done] + i + 1 + best
    return result, end


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from ``low`` to ``high`` of each pair, and the pair's number."""
    n = np.maximum(high - low + 1, 0)
    pair = np.repeat(np.arange(len(n)), n)
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()), pair


def _frames(group: np.ndarray, place: np.ndarray, bound: np.ndarray, room: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and starts of all windows that hold ``bound`` places of their group. Places are distinct and
    sorted in their group; a window covers ``room + 1`` of them and starts at ``last`` at most."""
    end = np.arange(len(group)) + bound - 1
    fits = end < len(group)
    begin, end = np.flatnonzero(fits), end[fits]
    fits = (group[end] == group[begin]) & (place[end] - place[begin] <= room[begin])
    begin, end = begin[fits], end[fits]
    low, high = np.maximum(place[end] - room[begin], 0), np.minimum(place[begin], last[begin])
    again = np.flatnonzero(group[begin[1:]] == group[begin[:-1]]) + 1  # starts up to the one before's are listed there
    low[again] = np.maximum(low[again], high[again - 1] + 1)
    start, pair = _spread(low, high)
    return group[begin][pair], start


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, window, start, edits) of the windows found in the texts; a window is
    named by its start in the item."""
    own = [_text(t) for t in texts]
    pad = 4 * WINDOW
    codes = _codes("\x00" * pad + "\x00".join(own) + "\x00" * pad)
    begins = pad + np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))
    found: list[tuple[int, int, int, int, int]] = []

    def add(item, window, start, end, edits) -> None:
        doc = np.searchsorted(begins, end - 1, side="right") - 1
        found.extend(zip(doc.tolist(), item.tolist(), window.tolist(), (start - begins[doc]).tolist(), edits.tolist()))

    hashes = _grams(codes)
    at = np.flatnonzero(index.table[hashes >> np.uint64(64 - _TABLE_BITS)])
    if not len(at):
        return found
    gram = np.searchsorted(index.grams, hashes[at])
    known = gram < len(index.grams)
    known[known] = index.grams[gram[known]] == hashes[at[known]]
    at, gram = at[known], gram[known]
    bound = np.maximum(index.size - Q + 1 - index.budget * Q, 1)
    # a place with fewer hits around it than the least bound can't be part of an occurrence
    reach, least = WINDOW + int(index.budget.max()), int(bound[index.length >= Q].min(initial=WINDOW))
    around = np.searchsorted(at, at + reach, side="right") - np.searchsorted(at, at - reach, side="left")
    at, gram = at[around >= least], gram[around >= least]
    if not len(at):
        return found
    first, hit = _spread(index.starts[gram], index.starts[gram + 1] - 1)
    item, place = index.item[first], index.place[first]
    diagonal = at[hit] - place + int(index.length.max())  # not below 0
    room, last = index.size - Q, index.length - index.size
    # exact: as many neighbouring hits on one diagonal as a window has q-grams
    line, line_of = np.unique(item * (1 << 40) + diagonal, return_inverse=True)
    order = np.lexsort((place, line_of))
    group, start = _frames(line_of[order], place[order], (room + 1)[item[order]], room[item[order]], last[item[order]])
    exact_item, exact_diagonal = line[group] >> 40, line[group] & ((1 << 40) - 1)
    shift = exact_diagonal - int(index.length.max()) + start
    add(exact_item, start, shift, shift + index.size[exact_item], np.zeros(len(start), int))
    # within the budget: two overlapping bands a diagonal
    step = index.budget[item] + 1
    band = item * (1 << 40) + diagonal // step
    key, key_of = np.unique(np.concatenate((band, band - 1)), return_inverse=True)
    wide = int(index.length.max()) + 1
    pairs = np.unique(key_of * wide + np.concatenate((place, place)))
    key_of, place = pairs // wide, pairs % wide
    item = ((key + 1) >> 40)[key_of]
    group, window = _frames(key_of, place, bound[item], room[item], last[item])
    # what a band holds exactly needs no alignment
    exact_band = exact_item * (1 << 40) + exact_diagonal // (index.budget[exact_item] + 1)
    done = np.concatenate([np.searchsorted(key, b) * wide + start for b in (exact_band, exact_band - 1)])
    todo = ~np.isin(group * wide + window, done)
    group, window = group[todo], window[todo]
    item = (key[group] + 1) >> 40
    start = (key[group] - item * (1 << 40)) * (index.budget[item] + 1) - int(index.length.max()) + window
    for part in np.array_split(np.arange(len(group)), -(-len(group) // STEP)) if len(group) else []:
        widths = 2 * (index.budget[item[part]] + 1)
        for width in np.unique(widths).tolist():
            mine = part[widths == width]
            edits, end = aligned(index, item[mine], window[mine], codes, start[mine], width)
            good = edits <= index.budget[item[mine]]
            mine, end = mine[good], end[good]
            add(item[mine], window[mine], end - index.size[item[mine]], end, edits[good])
    return found


def found_in(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """What ``search`` finds, and the items shorter than a q-gram at their first place in a text."""
    found = search(index, texts)
    own = [_text(t) for t in texts] if index.short else []
    codes = _codes("\x00".join(own))
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))
    for q, (hashed, items) in index.short.items():
        hashes = _grams(codes, q)
        low, high = np.searchsorted(hashed, hashes, side="left"), np.searchsorted(hashed, hashes, side="right")
        at = np.flatnonzero(high > low)
        which, pair = _spread(low[at], high[at] - 1)
        at, item = at[pair], items[which]
        doc = np.searchsorted(begins, at, side="right") - 1
        _, once = np.unique(doc * len(index.items) + item, return_index=True)
        found.extend((d, n, 0, int(a - begins[d]), 0) for d, n, a in zip(doc[once].tolist(), item[once].tolist(), at[once].tolist()))
    return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of the benchmark's blocks; a block is collected and broadcast by itself."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * chars // BLOCK_CHARS))
    for block in range(n if chars else 0):
        index = build([tuple(r) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block).collect()])
        if index is not None:
            yield index


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Contaminated documents: ``id_col``, ``item_col``, ``n_windows`` of the item found in the document,
    ``start`` of the first one in the normalised text and the least ``edits``."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, window int, start long, edits int"
    out = spark.createDataFrame([], schema)
    item_type = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for index in _blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = found_in(sent.value, part.column("text").to_pylist())
                    if found:
                        doc, item, window, start, edits = map(list, zip(*found))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(pa.array(doc)), pa.array([sent.value.items[n] for n in item], item_type), pa.array(window, pa.int32()), pa.array(start, pa.int64()), pa.array(edits, pa.int32())],
                            ["id", "item", "window", "start", "edits"],
                        )

        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(
        F.countDistinct("window").alias("n_windows"), F.min("start").alias("start"), F.min("edits").alias("edits")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any benchmark item; nothing is shuffled."""
    for index in _blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    hit = {doc for doc, *_ in found_in(sent.value, part.column(text_col).to_pylist())}
                    yield part.filter(pa.array([n not in hit for n in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
