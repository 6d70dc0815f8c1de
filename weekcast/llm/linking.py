"""From band buckets to verified links and classes, without all pairs of a bucket and without collecting.

``linked`` finds the classes that all similar pairs sharing a bucket would make. First every member is
checked against the least member of its bucket. Nodes have one order in all buckets, so the buckets of a
group share their least members and a node has few of them. Classes are formed, and only buckets that
still hold more than one class are looked at again: every pair of members of different classes is checked once.
Pairs within a class need no check, so a large group of near copies costs a few checks per member. In buckets
of many members, which are variants of one set or share a passage without being similar, nodes are compared by their differences from
one node, and only those pairs are listed that share a rare element of both (see ``_close_pairs``): in any one order of all
elements, similar sets have their first shared one within the first of either that make up what they need not share (prefix
filtering), and in the order of frequency those are the rare ones. Sets that have much of their mass in few elements differ in any number of
the others; their pairs are bounded by the mass from the first shared element on (see ``_uneven_pairs``). So nothing is lost and nothing
depends on a cap. Where the sets' elements can't be had, rounds of new pivots, in an order that differs from bucket to bucket, come before the listing instead.

Before any pair meets its texts, pairs go whose sizes rule the similarity out (``fits``): the mass that a set
has in common with another is at most its largest share times the other's distinct elements.

Hot buckets: which buckets are shared is found from blocks of band hashes that every task first makes
distinct; like nodes meet in many buckets, of which one of each set of nodes is kept; leads and pivots are partial aggregates, joined to the members by broadcast if small or else by a sort-merge join whose
hot keys Spark splits. Tables used twice are written below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, mix, written

#: For tables used twice within a star step; parts lost with an executor are made again from written ones.
KEPT = StorageLevel.MEMORY_AND_DISK
#: Band hashes that a task makes distinct at a time; parts of the bucket space for each shuffle partition.
CHUNK_BANDS, PARTS_PER_PARTITION = 1 << 20, 4
#: Slots that elements are counted in, as a power of two.
SLOT_BITS = 20
#: Parts that the counts of the slots are packed in.
RANGES = 64
#: A set of that many times its number of elements, by its length, has (nearly) equal shares.
EVEN = 1.02
#: A set of more than that many times is uneven: much of its mass is in few elements, whatever the number that differ.
UNEVEN = 1.5
#: Low bits of a bucket entry that tell nodes apart (two nodes of a bucket look alike there once in 16 million).
TAG_BITS = 24

#: Words of 64 bits in a membership filter: its size is fixed (8 MB); more keys only make it prune less.
FILTER_WORDS = 1 << 20
#: Without elements: rounds of new pivots for buckets that hold several classes, before their pairs are listed.
PIVOT_ROUNDS = 3
#: A mixed bucket of more members has its pairs found by shared rare elements.
LIGHT = 32
#: Edges that a task makes stars of at a time; passes before the star steps, and files a task takes in them.
CHUNK_EDGES = 1 << 20
PASSES, FAN_IN = 2, 8
#: Without elements: the pairs are listed as soon as there are no more than so many per membership.
PAIRS_PER_MEMBER = 16


def filter_of(keys: DataFrame, column: str) -> np.ndarray:
    """A fixed-size bit filter of the keys (64-bit hashes): what isn't in it is not among them."""
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")
    words = keys.select(F.expr(f"shiftrightunsigned({column}, 6) & {FILTER_WORDS - 1}").alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For 64-bit keys: whether the filter may hold them."""
    keys = keys.view(np.uint64)
    word = (keys >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)
    return (bits[word] >> (keys & np.uint64(63))) & np.uint64(1) == 1


def _stirred(node: str, by: Column) -> Column:
    """An order of nodes that differs from bucket to bucket and can be undone by doing it again."""
    return F.col(node).bitwiseXOR(by)


def _named(high: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The names of buckets of which the high bits are known, and the part of the bucket space that the low ones chose."""
    return mix(high | part).view(np.int64)


def _reduced(buckets: np.ndarray, parts: int) -> np.ndarray:
    low = np.uint64((1 << TAG_BITS) - 1)
    buckets = buckets.view(np.uint64)
    return _named(buckets & ~low, (buckets & low) % np.uint64(parts))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, rising; by a sort, as the table of hashes that ``np.unique`` makes of mostly distinct ones costs far more."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _several(rows: DataFrame, parts: int) -> DataFrame:
    """The written names of the buckets that hold two nodes or more (rows of node, bands); of buckets of the same nodes, one.

    Buckets of the same nodes would give the same pairs. A sum of the nodes' mixed tags tells them: those of two pairs
    of nodes are equal with odds of 1 in 2**47."""
    low, shift = np.uint64((1 << TAG_BITS) - 1), np.uint64(TAG_BITS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of entries (bucket's high bits, node's tag) for each part of the bucket space."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            buckets, tags = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # 16-bit numbers sort in one pass
            part = ((buckets & low) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            part, entries = part[order], ((buckets & ~low) | tags)[order]
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            blobs = [_distinct(x).tobytes() for x in np.split(entries, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "entries"])

        for batch in batches:
            column = batch.column("bands")
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            tags = mix(batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)) & low
            held.append((flat, np.repeat(tags, sizes)))
            if sum(len(x) for x, _ in held) >= CHUNK_BANDS:
                yield block()
        if held and any(len(x) for x, _ in held):
            yield block()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, entries in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
                found.setdefault(part, []).append(np.frombuffer(entries, np.uint64))
        for part in list(found):
            entries = _distinct(np.concatenate(found.pop(part)))
            high = entries >> shift
            starts = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
            several = np.diff(starts, append=len(high)) > 1
            nodes = np.add.reduceat(mix(entries & low), starts)[several].view(np.int64)
            names = _named(high[starts[several]] << shift, np.uint64(part))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(nodes)], ["bucket", "nodes"])

    blocks = rows.mapInArrow(packed, "part int, entries binary").repartition("part")
    found = blocks.mapInArrow(compared, "bucket long, nodes long")
    return written(found.groupBy("nodes").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")


def shared_buckets(sketches: DataFrame, node: str = "node", bands: str = "bands", sizes: tuple[str, str] | None = None) -> DataFrame:
    """The written memberships (bucket, node) of all buckets that hold two nodes or more (of buckets of the same nodes, one), with the columns
    ``size`` and ``peak`` if ``sizes`` names those of the sketches (see :func:`linked`)."""
    spark = sketches.sparkSession
    parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = [F.col(c).cast("float").alias(name) for c, name in zip(sizes or (), ("size", "peak"))]
    rows = sketches.select(F.col(node).alias("node"), F.col(bands).alias("bands"), *extra).where("node IS NOT NULL AND bands IS NOT NULL")
    several = _several(rows.select("node", "bands"), parts)
    bits = spark.sparkContext.broadcast(filter_of(several, "bucket"))
    names = ["size", "peak"][: len(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("bands")
            flat = _reduced(column.flatten().to_numpy(zero_copy_only=False), parts)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            keep = may_hold(bits.value, flat)
            others = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lengths)[keep] for c in ("node", *names)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), *map(pa.array, others)], ["bucket", "node", *names])

    likely = rows.mapInArrow(run, "bucket long, node long" + "".join(f", {c} float" for c in names))
    members = written(likely.join(several, "bucket", "left_semi").distinct(), "members")
    bits.destroy()
    dropped(several)
    return members


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (u, v) as stars: every node with the least node that they connect it to."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
    while (label[label] != label).any():
        label = label[label]
    leaves = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaves], nodes[label[leaves]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges with those of each task (``CHUNK_EDGES`` at a time) made stars: the same components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            u, v = (np.concatenate(x) for x in zip((u, v), more))
            if len(u) >= CHUNK_EDGES:
                u, v = _forest(u, v)
                if len(u) >= CHUNK_EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(u):
            u, v = _forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _last_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of all nodes of the edges, which are all there are and no more than a task takes."""
    parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")] for batch in batches]
    if parts:
        leaves, roots = _forest(*(np.concatenate(x) for x in zip(*parts)))
        own = np.unique(roots)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((leaves, own))), pa.array(np.concatenate((roots, own)))], ["node", "class_id"])


def components(links: DataFrame) -> DataFrame:
    """The written ``node`` and ``class_id`` (the least node of its class) of every node of the links ``a``, ``b``.

    Every task first makes stars of its own links. Where no more than ``CHUNK_EDGES`` are left, which is what any task
    takes at a time, one more task ends it. Else ``PASSES`` more passes make stars of ``FAN_IN`` tasks'
    stars together, a bounded number of edges at a time, and where that is not the end, alternating
    large-star and small-star steps follow, each round with such a pass. Each round's edges are a written table, so a lost executor costs at most one round;
    what a round needs twice is kept by the executors and made again if lost. Ends when every edge
    leads from a node with one edge to one without.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(_contracted(pairs), "edges")
    if edges.count() <= CHUNK_EDGES:
        found = written(edges.coalesce(1).mapInArrow(_last_classes, "node long, class_id long"), "classes")
        dropped(edges)
        return found
    turn = 0
    while True:
        heads = edges.groupBy("u").agg(F.count("*").alias("n"))
        tails = edges.select(F.col("v").alias("u")).distinct()
        if not heads.where("n > 1").select("u").union(heads.join(tails, "u").select("u")).limit(1).count():
            break
        if turn < PASSES:
            together = max(1, len(edges.inputFiles()) // FAN_IN)
            small = written(_contracted(edges.coalesce(together)), "edges")
        else:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).persist(KEPT)
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().persist(KEPT)
            lower = large.groupBy("u").agg(F.min("v").alias("m")).persist(KEPT)
            joined = large.join(lower, "u")
            small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = written(_contracted(small.unionByName(lower.withColumnRenamed("m", "v")).where("u <> v").distinct()), "small-star")
            for old in (least, large, lower):
                old.unpersist()
        dropped(edges)
        edges, turn = small, turn + 1
    roots = edges.select(F.col("v").alias("node")).distinct()
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("class_id"))
    found = written(leaves.unionByName(roots.select("node", F.col("node").alias("class_id"))), "classes")
    dropped(edges)
    return found


def _paired(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _slots(elements: np.ndarray) -> np.ndarray:
    return (mix(elements.view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def _rarity(elements: DataFrame, column: str) -> np.ndarray:
    """How often the elements of each of a fixed number of slots occur (4 MB): what orders them by rarity.

    Tasks give their counts in ``RANGES`` packed parts, which are added up part by part."""
    width = (1 << SLOT_BITS) // RANGES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_slots(batch.column(column).flatten().to_numpy(zero_copy_only=False)), minlength=1 << SLOT_BITS)
        slots = np.flatnonzero(total)
        ranges, starts = np.unique(slots // width, return_index=True)
        packed = [[x.tobytes() for x in np.split(v, starts[1:])] if len(slots) else [] for v in (slots, total[slots])]
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), *[pa.array(v, pa.binary()) for v in packed]], ["range", "slots", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for slots, counts in zip(batch.column("slots").to_pylist(), batch.column("counts").to_pylist()):
                total[np.frombuffer(slots, np.int64)] += np.frombuffer(counts, np.int64)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([slots.tobytes()]), pa.array([total[slots].tobytes()])], ["slots", "counts"])

    parts = elements.select(column).mapInArrow(counted, "range long, slots binary, counts binary").repartition("range")
    out = np.zeros(1 << SLOT_BITS, np.uint32)
    found = parts.mapInArrow(added, "slots binary, counts binary").toArrow()
    for slots, counts in zip(found.column("slots").to_pylist(), found.column("counts").to_pylist()):
        out[np.frombuffer(slots, np.int64)] = np.minimum(np.frombuffer(counts, np.int64), 0xFFFFFFFF)
    return out


def _differences(groups: DataFrame, elements: DataFrame) -> DataFrame:
    """The written ``groups`` (pivot, node, ...) with ``diff``, the elements that only one of node and pivot has, their number ``d``,
    the node's number of elements ``n`` and the lengths ``length`` and ``length_p`` of node and pivot (see :func:`_close_pairs`)."""
    ends = groups.select("node").union(groups.select(F.col("pivot").alias("node"))).distinct()
    sets = elements(ends).select("node", "elements", (2 / F.array_min("shares") - F.size("elements")).alias("length"))
    sets = written(sets, "heavy-sets")
    pivots = sets.select(F.col("node").alias("pivot"), F.col("elements").alias("elements_p"), F.col("length").alias("length_p"))
    others = [c for c in groups.columns]
    both = groups.join(sets, "node").join(pivots, "pivot").select(*others, "length", "length_p", "elements", "elements_p")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    passed = [*others, "length", "length_p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, of = (batch.column(c) for c in ("elements", "elements_p"))
            diffs, n = [], []
            for at in range(batch.num_rows):
                x, y = np.asarray(own[at].values), np.asarray(of[at].values)
                diffs.append(np.setxor1d(x, y, assume_unique=True))
                n.append(len(x))
            d = pa.array([len(x) for x in diffs], pa.int32())
            columns = [*[batch.column(c) for c in passed], pa.array(n, pa.int32()), d, pa.array(diffs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*passed, "n", "d", "diff"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in passed) + ", n int, d int, diff array<long>"
    found = written(both.mapInArrow(run, schema), "differences")
    dropped(sets)
    return found


def _by_rarity(flat: np.ndarray, lengths: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of elements one after the other: the order that sorts each by rarity, how often each element
    occurs in that order, and the list that each belongs to."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    often = rarity[_slots(flat)]
    order = np.lexsort((flat, often, row))
    return order, often[order], row


def _uneven_prefixes(groups: DataFrame, elements: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """The written elements of the ``groups`` (pivot, node, ...) that the first shared one of a pair of similarity ``least`` can be, in
    the order of rarity, and the share ``rest`` of the set's mass from there on (see :func:`_uneven_pairs`)."""
    sets = written(elements(groups.select("node").distinct()).select("node", "elements", "shares"), "uneven-sets")
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets, "elements"))
    kept = groups.columns
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, shares = batch.column("elements"), batch.column("shares").flatten().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            order, often, row = _by_rarity(flat, lengths, rarity.value)
            flat, mass = flat[order], shares[order]
            upto = np.cumsum(mass) - mass
            rest = 1 - (upto - np.repeat(upto[np.cumsum(lengths) - lengths], lengths))
            chosen = (often > 1) & (rest >= least - 1e-6)
            which = pa.array(row[chosen])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(which) for c in kept], pa.array(flat[chosen]), pa.array(rest[chosen])], [*kept, "element", "rest"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", element long, rest double"
    found = written(groups.join(sets, "node").select(*kept, "elements", "shares").mapInArrow(run, schema), "uneven-prefixes")
    dropped(sets)
    return found


def _uneven_pairs(prefixes: DataFrame, least: float, sizes: list[str], may_link: Column, hubs: bool) -> DataFrame:
    """The pairs (a, b) of nodes of one pivot and different classes, of which one is ``uneven``, that may have the similarity ``least``;
    with ``hubs`` only those of a node and, of the nodes that have one of its elements, the one of the largest rest there.

    Sets that have the shares P and Q of their mass in shared elements have a similarity of 1 / (1 / P + 1 / Q - 1) at most: that is
    what they have if the shared elements' shares are in proportion, and any others give less (the sum's terms are concave
    and homogeneous in both shares). From the first shared element on, each has at least that mass left.
    Who isn't close to the hub of an element is close to none there, so the classes that hubs make leave few pairs."""
    names = ["node", "class_id", "uneven", "rest", *sizes]
    other = [F.col(c).alias(f"{c}2") for c in names]
    close = (F.col("class_id") != F.col("class_id2")) & may_link & (1 / F.col("rest") + 1 / F.col("rest2") <= 1 + 1 / least + 1e-5)
    if hubs:
        best = prefixes.groupBy("pivot", "element").agg(F.max(F.struct("rest", *[c for c in names if c != "rest"])).alias("p"))
        best = best.select("pivot", "element", *[F.col(f"p.{c}").alias(f"{c}2") for c in names])
        found = prefixes.join(best, ["pivot", "element"]).where(close & (F.col("uneven") | F.col("uneven2")))
    else:
        first = F.struct(~F.col("uneven"), "node") < F.struct(~F.col("uneven2"), "node2")
        found = prefixes.where("uneven").join(prefixes.select("pivot", "element", *other), ["pivot", "element"]).where(close & first)
    return found.select(*_paired("node", "node2")).distinct()


def _close_pairs(diffs: DataFrame, least: float, sizes: list[str], may_link: Column) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of nodes of one pivot and different classes that may have the similarity ``least`` (some several times),
    and the written table that they are made from.

    With the length of a set, 2 / its least share less its number of elements (of equal shares: this number), sets x
    and y of that similarity differ in at most c * (length(x) + length(y)) elements, c = (1 - least) / (1 + least). Their differences
    from the pivot then have at least ``o`` elements in common, half of what both differences have more than that. Where that is no more
    than none, pairs are listed. Else the first shared element, in the order of rarity, is no later than ``o`` elements before the end of either
    difference. Of a pair the smaller difference shares an element of its ``short`` part: as at least one
    of both is not like the pivot, that is about its rarer half, in which few nodes meet, while what many lack of the pivot comes last.
    Nodes like the pivot but of another class, and those with repeated elements, are ``odd``: they come first in their pairs, with all elements."""
    c, slack = (1 - least) / (1 + least), 1e-3
    near = F.col("d") <= c * (F.col("length") + F.col("length_p")) + slack
    odd = (F.col("length") > EVEN * F.col("n")) | (near & (F.col("class_id") != F.col("class_p")))
    largest = EVEN / (1 - (1 - least) * (1 + EVEN) / 2)  # a partner's length at most, by the node's elements
    common = F.when(near, (F.col("d") + c * (F.col("length_p") - F.col("length"))) / 2).otherwise(F.col("d") - c * (F.col("length") + largest * F.col("n")) / 2)
    # the larger difference of a pair: of a node like the pivot only if its partner, unlike it, has far fewer elements
    fewest = 1 - (1 - least) * (1 + EVEN) / 2
    inner = F.when(near & (F.col("d") <= c * (fewest * F.col("n") + F.col("length_p")) - slack), F.col("d") + 1).when(near, 0.0)
    inner = inner.otherwise((F.col("d") - c * (F.col("length") + EVEN * F.col("length_p"))) / 2 - slack)
    rows = diffs.withColumn("odd", odd).withColumn("upto", F.col("d") - F.when(F.col("odd"), 0.0).otherwise(common - slack))
    mixed = rows.where("odd").select("pivot").distinct().withColumn("with_odd", F.lit(True))
    rows = rows.join(mixed, "pivot", "left").withColumn("upto_long", F.col("d") - F.when(F.coalesce("with_odd", F.lit(False)), 0.0).otherwise(inner))
    kept = ["pivot", "node", "class_id", *sizes, "length", "d", "odd"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rarity = diffs.sparkSession.sparkContext.broadcast(_rarity(diffs, "diff"))

    def ordered(few: bool, shorts=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("diff")
                flat = column.flatten().to_numpy(zero_copy_only=False)
                lengths = column.value_lengths().to_numpy(zero_copy_only=False)
                order, often, row = _by_rarity(flat, lengths, rarity.value)
                flat = flat[order]
                at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                upto = batch.column("upto" if few else "upto_long").to_numpy(zero_copy_only=False)
                chosen = (often > 1) & (at <= np.repeat(upto, lengths))  # what occurs once is shared by none
                if not few:
                    chosen &= may_hold(shorts.value, flat)
                which = pa.array(row[chosen])
                columns = [batch.column(c).take(which) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flat[chosen]), pa.array(at[chosen].astype(np.int32))], [*kept, "element", "at"])

        return run

    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", element long, at int"
    # spread again: the groups of a pivot have met in a task
    rows = rows.select(*kept, "upto", "upto_long", "diff").repartition("node")
    short = written(rows.mapInArrow(ordered(True), schema), "prefixes")
    bits = diffs.sparkSession.sparkContext.broadcast(filter_of(short, "element"))
    long = rows.mapInArrow(ordered(False, bits), schema)
    other = long.select("pivot", "element", *[F.col(x).alias(f"{x}2") for x in (*kept[1:], "at")])
    o = (F.col("d") + F.col("d2") - c * (F.col("length") + F.col("length2")) - slack) / 2
    first = F.struct(~F.col("odd"), "d", "node") < F.struct(~F.col("odd2"), "d2", "node2")
    close = (F.col("class_id") != F.col("class_id2")) & may_link & first & (o > 0) & (F.col("d") - F.col("at") >= o) & (F.col("d2") - F.col("at2") >= o)
    shared = short.join(other, ["pivot", "element"]).where(close).select(*_paired("node", "node2"))
    # differences so small that nothing of them need be shared
    small = diffs.drop("diff").withColumn("room", c * F.col("length") - F.col("d") + slack)
    foreign = F.col("class_id") != F.col("class_p")
    bounds = small.groupBy("pivot").agg(F.max("room").alias("most"), F.max(F.when(foreign, F.col("room"))).alias("most_foreign"))
    small = small.join(bounds, "pivot")
    foreigners = small.where(foreign & (F.col("room") + F.col("most") >= 0))
    partners = small.where(F.col("room") + F.col("most_foreign") >= 0).select("pivot", *[F.col(x).alias(f"{x}2") for x in ("node", "class_id", *sizes, "room")])
    free = foreigners.join(partners, "pivot").where((F.col("class_id") != F.col("class_id2")) & may_link & (F.col("room") + F.col("room2") >= 0))
    return shared.unionByName(free.select(*_paired("node", "node2"))), short


def linked(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: float | None = None, elements: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The links (a, b) that connect all similar pairs sharing a bucket, as a union of written tables.

    ``members`` is a table of distinct (bucket, node); ``verify`` gives the links among pairs (a, b). With
    ``fits``, the least similarity of a link, members also have ``size``, a set's distinct elements, and ``peak``,
    the largest share that one element has of it: a pair of which ``size * peak`` of either with the other is less goes unverified.
    ``elements`` gives a row of given nodes each, (node, elements, shares: of the node's mass), where links need the probability Jaccard
    similarity ``fits`` of the shares; of equal shares that is the Jaccard similarity.
    """
    sizes = ["size", "peak"] if fits is not None else []
    least_fit = (fits or 0.0) * (1 - 1e-5)  # the columns are single precision

    def may_link(other: str) -> Column:
        if not sizes:
            return F.lit(True)
        return (F.col("size") * F.col(f"peak{other}") >= least_fit) & (F.col(f"size{other}") * F.col("peak") >= least_fit)

    def renamed(suffix: str) -> list[Column]:
        return [F.col(c).alias(f"{c}{suffix}") for c in sizes]

    # every member against the least of its bucket
    least = members.groupBy("bucket").agg(F.min(F.struct("node", *sizes)).alias("p"))
    leads = written(least.select("bucket", F.col("p.node").alias("lead"), *[F.col(f"p.{c}").alias(f"{c}2") for c in sizes]), "leads")
    near = members.join(leads, "bucket").where((F.col("node") > F.col("lead")) & may_link("2")).select("lead", "node").distinct()
    tested = [written(near.select(F.col("lead").alias("a"), F.col("node").alias("b")), "pairs")]
    links = [written(verify(tested[0]), "links")]
    for turn in range(1, PIVOT_ROUNDS + 2):
        classes = components(_union(links))
        owned = members.join(classes, "node", "left").select("bucket", "node", F.coalesce("class_id", "node").alias("class_id"), *sizes)
        parts = owned.groupBy("bucket", "class_id").agg(F.count("*").alias("n")).groupBy("bucket").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.max(F.struct("n", "class_id")).alias("most"), F.count("*").alias("k")
        )
        # a bucket of two has had its pair checked
        parts = written(parts.where("k > 1 AND n > 2").select("bucket", "n", "n2", F.col("most.class_id").alias("main")), "mixed-buckets")
        left = parts.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("n2")) / 2), F.max("n")).first()
        if not left[0]:
            for old in (parts, classes):
                dropped(old)
            break
        mixed = written(owned.join(parts.select("bucket", "main", "n"), "bucket").join(leads.select("bucket", "lead"), "bucket"), "mixed")
        spent: list[DataFrame] = []
        last = elements is not None or turn > PIVOT_ROUNDS or left[1] <= PAIRS_PER_MEMBER * left[0]
        if last:  # every pair of members of different classes, the leads' excepted: one of the two is outside the bucket's largest class
            rest = mixed.where("node > lead").drop("lead")
            heavy = F.col("n") > LIGHT if elements else F.lit(False)
            light = rest.where(~heavy)
            other = light.select(F.col("bucket").alias("bucket2"), F.col("node").alias("node2"), F.col("class_id").alias("class2"), *renamed("2"))
            unlike = (F.col("class_id") != F.col("class2")) & ((F.col("class2") == F.col("main")) | (F.col("node") < F.col("node2"))) & may_link("2")
            new = light.where("class_id <> main").join(other, (F.col("bucket") == F.col("bucket2")) & unlike).select(*_paired("node", "node2"))
            if elements and left[2] > LIGHT:
                groups = written(rest.where(heavy).select(F.col("main").alias("pivot"), "node", "class_id", *sizes).distinct(), "heavy-nodes")
                diffs = _differences(groups, elements)
                uneven = F.col("length") > UNEVEN * F.col("n")
                marked = diffs.select("pivot", "node", "class_id", *sizes, uneven.alias("uneven"))
                prefixes = None
                if marked.where("uneven").limit(1).count():
                    prefixes = _uneven_prefixes(marked.join(marked.where("uneven").select("pivot").distinct(), "pivot", "left_semi"), elements, least_fit)
                c = (1 - fits) / (1 + fits)
                like = diffs.where((F.col("class_id") != F.col("pivot")) & (F.col("d") <= c * (F.col("length") + F.col("length_p"))))
                like = like.select(*_paired("node", "pivot"))
                if prefixes:
                    like = like.unionByName(_uneven_pairs(prefixes, least_fit, sizes, may_link("2"), hubs=True))
                like = like.distinct().join(tested[0], ["a", "b"], "left_anti")
                tested.append(written(like, "pairs"))
                links.append(written(verify(tested[-1]), "links"))
                named = components(_union(links))
                of_pivot = named.select(F.col("node").alias("pivot"), F.col("class_id").alias("class_p"))
                labelled = diffs.drop("class_id").join(named, "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))
                labelled = labelled.join(of_pivot, "pivot", "left").withColumn("class_p", F.coalesce("class_p", "pivot"))
                labelled = written(labelled, "differences")
                close, short = _close_pairs(labelled.where(~uneven), fits, sizes, may_link("2"))
                new, spent = new.unionByName(close), [groups, diffs, named, labelled, short]
                if prefixes:
                    prefixed = prefixes.drop("class_id").join(named, "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))
                    apart = _uneven_pairs(prefixed, least_fit, sizes, may_link("2"), hubs=False).join(tested[-1], ["a", "b"], "left_anti")
                    new, spent = new.unionByName(apart), [*spent, prefixes]
        else:
            by = F.xxhash64("bucket", F.lit(turn))
            least = mixed.groupBy("bucket").agg(F.min(F.struct(_stirred("node", by).alias("x"), "class_id", *sizes)).alias("p"))
            chosen = least.select("bucket", _stirred("p.x", by).alias("pivot"), F.col("p.class_id").alias("of"), *[F.col(f"p.{c}").alias(f"{c}2") for c in sizes])
            new = mixed.join(chosen, "bucket").where((F.col("class_id") != F.col("of")) & may_link("2")).select(*_paired("node", "pivot"))
        new = new.distinct()
        if not elements:  # pairs of several rounds
            new = new.join(_union(tested), ["a", "b"], "left_anti")
        tested.append(written(new, "pairs"))
        links.append(written(verify(tested[-1]), "links"))
        for old in (parts, mixed, classes, *spent):
            dropped(old)
        if last:
            break
    for old in (leads, *tested):
        dropped(old)
    return _union(links)
