"""Prefix trie of conversations by fixed-length block hashing.

A node is a distinct sequence of first turns. Conversations are cut into blocks of ``BLOCK`` turns
and grouped by the digests of their successive blocks first, one row a block instead of one a turn. Only
where the conversations of a block's start don't all go on with the same whole block (siblings
diverge, or one ends inside) are the block's turns looked at one by one; everywhere else the nodes
inside a block have the members of its end, and a block that one conversation alone has reached needs
no grouping at all.

Prefixes are known by 128 bits, the exclusive or of the turns' digests, each taken with its position; two
different ones are taken for equal with odds of 1 in 2**128 a pair. Texts don't travel: a turn is a
digest, a length and a position.

Sums over subtrees need no walk over the trie. A node belongs to its smallest member, which then
owns every deeper node of its own too; so what a node's subtree sums up is what its members own at that
depth or below, a running sum along each conversation and one aggregate over the members. An owner's
nodes hang from the last node on its way that isn't its own.

Hot keys: turns are ranked by a range-partitioned sort, running values go in chunks of
``CHUNK`` blocks whose totals are added up first, groups are partial aggregates, and joins back to the
members have one row a key on their other side, so Spark can split their hot keys. The digest of the
ids that end at a node is sequential by its definition: the ids come sorted to the node's task, which
streams them through the hash and holds one batch.

Defined cases: rows without a conversation id take no part; null roles and texts are empty; turns of
equal number are ordered by their digest (of role and text); repeated rows are turns each; an empty table
gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.stats import ranks_within_groups
from .common import written

#: Turns a block; blocks a chunk of a running value.
BLOCK, CHUNK = 4, 4096
#: Conversations take the first turns of the conversation whose id is their own rounded down to a multiple of this.
FAMILY, MOST_SHARED = 100, 6

NOTHING = hashlib.sha256(b"").hexdigest()


def ranked_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``depth`` (from 1, in the order of ``turn``, nulls first), ``digest`` (hex) and ``n`` (code points) of every turn."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(t).cast("long").alias("n"))
    ranked = ranks_within_groups(turns, ["conv"], ["turn", "digest"])
    return ranked.select("conv", (F.col("_rank") + 1).alias("depth"), "digest", "n")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Ranked turns and ``length`` of every conversation as the query wants them: the first h turns of the
    conversation of the family's first id, then its own from h on, h = crc32(id) % 6. A conversation that ends up without
    turns has one row with a null ``depth``."""
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = own.select("conv", "own", (F.col("conv") - F.col("conv") % FAMILY).alias("first"), (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).alias("h"))
    firsts = own.select(F.col("conv").alias("first"), F.col("own").alias("there"))
    heads = heads.join(firsts, "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    heads = written(heads.select("conv", "first", "h", "taken", length.alias("length")), "trie-conversations")
    shared = turns.where((F.col("depth") < MOST_SHARED) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "first")
    taken = heads.join(shared, "first").where("depth <= h").select("conv", "length", "depth", "digest", "n")
    kept = turns.join(heads, "conv").where("depth > h").select("conv", "length", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "digest", "n")
    none = F.lit(None)
    empty = heads.where("length = 0").select("conv", "length", none.cast("long").alias("depth"), none.cast("string").alias("digest"), none.cast("long").alias("n"))
    return taken.unionByName(kept).unionByName(empty)


def _running(rows: DataFrame, by: str, at: str, of: list[str], fold, falling: bool = False) -> DataFrame:
    """``rows`` with ``before_<column>``: what ``fold`` makes of the column over the rows of ``by`` before this one in
    the order of ``at`` (after it, if ``falling``); null where there is none. Chunks of ``at`` are folded first."""
    order = F.col(at).desc() if falling else F.col(at)
    rows = rows.withColumn("_chunk", F.floor(F.col(at) / CHUNK).cast("long"))
    chunks = rows.groupBy(by, "_chunk").agg(*[fold(c).alias(f"_in_{c}") for c in of])
    first = Window.partitionBy(by).orderBy(F.col("_chunk").desc() if falling else F.col("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(by, "_chunk", *[fold(f"_in_{c}").over(first).alias(f"_to_{c}") for c in of])
    inside = Window.partitionBy(by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(chunks, [by, "_chunk"]).withColumns({f"_of_{c}": fold(c).over(inside) for c in of})
    both = {f"before_{c}": _folded(f"_to_{c}", f"_of_{c}", fold) for c in of}
    return found.withColumns(both).drop("_chunk", *[f"{k}{c}" for c in of for k in ("_to_", "_of_")])


def _folded(a: str, b: str, fold) -> Column:
    x, y = F.col(a), F.col(b)
    whole = x.bitwiseXOR(y) if fold is F.bit_xor else x + y
    return F.coalesce(whole, x, y)


def _blocks(turns: DataFrame) -> DataFrame:
    """The written blocks: ``conv``, ``length``, ``block``, its ``turns`` (depth, x, y, n; ``BLOCK`` at most) and the
    prefix keys (x0, y0) before and (x1, y1) after it."""
    placed = turns.where("depth IS NOT NULL")
    keyed = placed.select(
        "conv",
        "length",
        F.floor((F.col("depth") - 1) / BLOCK).cast("long").alias("block"),
        F.struct("depth", F.xxhash64("depth", "digest").alias("x"), F.xxhash64("digest", F.negative("depth")).alias("y"), "n").alias("t"),
    )
    blocks = keyed.groupBy("conv", "length", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.bit_xor("t.x").alias("x"), F.bit_xor("t.y").alias("y"))
    blocks = _running(blocks, "conv", "block", ["x", "y"], F.bit_xor)
    start = {f"{c}0": F.coalesce(f"before_{c}", F.lit(0)) for c in ("x", "y")}
    blocks = blocks.withColumns(start).select("conv", "length", "block", "turns", "x0", "y0", F.col("x0").bitwiseXOR(F.col("x")).alias("x1"), F.col("y0").bitwiseXOR(F.col("y")).alias("y1"))
    return written(blocks, "trie-blocks")


def _grouped(rows: DataFrame) -> DataFrame:
    """Members (``n_convs``) and least member (``owner``) of every node (depth, x, y)."""
    return rows.groupBy("depth", "x", "y").agg(F.count("*").alias("n_convs"), F.min("conv").alias("owner"))


def _visits(blocks: DataFrame, total: int) -> DataFrame:
    """conv, length, depth, n (code points), ``n_convs``, ``owner`` and ``whole`` of what the conversations pass:
    every member's row of the nodes at block ends and inside diverging blocks; of the others, whose members
    are those of ``whole``, the depth of the block's end (null for nodes of one member), the owner's row alone."""
    full = F.size("turns") == BLOCK
    ends = _grouped(blocks.where(full).select("conv", ((F.col("block") + 1) * BLOCK).alias("depth"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    ends = written(ends, "trie-ends")
    at_start = ends.select((F.col("depth") / BLOCK).cast("long").alias("block"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("n_convs").alias("n0"))
    at_end = ends.select((F.col("depth") / BLOCK - 1).cast("long").alias("block"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n_convs").alias("n1"), F.col("owner").alias("owner1"))
    later = blocks.where("block > 0").join(at_start, ["block", "x0", "y0"])
    judged = blocks.where("block = 0").withColumn("n0", F.lit(total)).unionByName(later)
    judged = judged.join(at_end, ["block", "x1", "y1"], "left")
    judged = judged.withColumn("n1", F.when(full, F.col("n1"))).withColumn("owner1", F.when(full, F.col("owner1")))
    alone, same = F.col("n0") == 1, F.coalesce(F.col("n1") == F.col("n0"), F.lit(False))
    kind = F.when(alone, "alone").when(same, "same").otherwise("diverging")
    judged = written(judged.select("conv", "length", "block", "turns", "x0", "y0", "n1", "owner1", kind.alias("kind")), "trie-judged")

    one = judged.select("conv", "length", "kind", "n1", "owner1", F.explode("turns").alias("t")).select("conv", "length", "kind", "n1", "owner1", "t.depth", "t.n")
    last = F.col("depth") % BLOCK == 0
    block_end = (F.ceil(F.col("depth") / BLOCK) * BLOCK).cast("long")
    single = one.where("kind = 'alone'").select("conv", "length", "depth", "n", F.lit(1).cast("long").alias("n_convs"), F.col("conv").alias("owner"), F.lit(None).cast("long").alias("whole"))
    inside = one.where((F.col("kind") == "same") & ~last & (F.col("owner1") == F.col("conv")))
    inside = inside.select("conv", "length", "depth", "n", F.col("n1").alias("n_convs"), F.col("owner1").alias("owner"), block_end.alias("whole"))
    at_ends = one.where((F.col("kind") != "alone") & last).select("conv", "length", "depth", "n", F.col("n1").alias("n_convs"), F.col("owner1").alias("owner"), F.col("depth").alias("whole"))

    def key(c: str) -> Column:
        """The prefix key after each turn of the block."""
        return F.transform("turns", lambda t, i: F.aggregate(F.slice("turns", F.lit(1), i + 1), F.col(f"{c}0"), lambda a, u: a.bitwiseXOR(u[c])))

    refined = judged.where("kind = 'diverging'").select("conv", "length", F.explode(F.arrays_zip(F.col("turns").alias("t"), key("x").alias("kx"), key("y").alias("ky"))).alias("z"))
    refined = refined.select("conv", "length", F.col("z.t.depth").alias("depth"), F.col("z.t.n").alias("n"), F.col("z.kx").alias("x"), F.col("z.ky").alias("y")).where(~last)
    refined = written(refined, "trie-refined")
    refined = refined.join(_grouped(refined), ["depth", "x", "y"]).select("conv", "length", "depth", "n", "n_convs", "owner", F.col("depth").alias("whole"))
    return written(single.unionByName(inside).unionByName(at_ends).unionByName(refined), "trie-visits")


def _ends(lasts: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``n_ends`` and ``ends_sha256`` of the nodes at which conversations end (rows of conv, depth, owner)."""
    near = lasts.select("owner", "depth", "conv").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, count = None, None, 0
        for batch in batches:
            done = []
            for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv"))):
                if (owner, depth) != node:
                    if node is not None:
                        done.append((*node, count, ids.hexdigest()))
                    node, ids, count = (owner, depth), hashlib.sha256(str(conv).encode()), 1
                else:
                    ids.update(f",{conv}".encode())
                    count += 1
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "depth", "n_ends", "ends_sha256"), map(list, zip(*done)))))
        if node is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "n_ends": [count], "ends_sha256": [ids.hexdigest()]})

    return near.mapInArrow(run, "conv_id long, depth long, n_ends long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (see :func:`rebuilt`): conv_id (its owner), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    turns = written(turns, "trie-turns")
    convs = turns.groupBy("conv").agg(F.max("length").alias("length"))
    top = convs.agg(F.count("*").alias("n"), F.min("conv").alias("least")).first()
    total, least = top["n"], top["least"] if top["n"] else 0
    visits = _visits(_blocks(turns), total)

    own = F.col("owner") == F.col("conv")
    lasts = visits.where("depth = length").select("owner", "depth", "conv")
    lasts = lasts.unionByName(convs.where("length = 0").select(F.lit(least).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv"))
    ends = written(_ends(lasts), "trie-node-ends")
    # the last node on the way of a conversation that another one owns: there its own nodes hang
    way = visits.where(~own).groupBy("conv").agg(F.max(F.struct("depth", "owner")).alias("p"))
    hangs = convs.where((F.col("conv") != least) & (F.col("length") > 0)).join(way, "conv", "left").select(
        "conv", "length", F.coalesce("p.depth", F.lit(0).cast("long")).alias("from_depth"), F.coalesce("p.owner", F.lit(least).cast("long")).alias("from_conv")
    )
    hangs = written(hangs.where("from_depth < length"), "trie-hangs")

    # sums of subtrees: what the members own at this depth or below
    nodes = visits.where(own)
    nodes = nodes.join(ends.select(F.col("conv_id").alias("conv"), "depth", "n_ends"), ["conv", "depth"], "left")
    leaf = (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("long")
    owned = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("n")).alias("saved"), leaf.alias("leaf"), "n_convs", "owner", "whole")
    passing = visits.where(~own).select("conv", "depth", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"), "n_convs", "owner", "whole")
    below = _running(owned.unionByName(passing), "conv", "depth", ["saved", "leaf"], F.sum, falling=True)
    sums = {c: F.col(c) + F.coalesce(f"before_{c}", F.lit(0)) for c in ("saved", "leaf")}
    below = written(below.withColumns(sums).select("conv", "depth", "saved", "leaf", "n_convs", "owner", "whole"), "trie-below")
    members = below.where("whole = depth").groupBy("owner", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    members = written(members, "trie-sums")
    # a node inside a block that all its members have whole: the chain down to the block's end, and that end's sums
    inner = below.where("whole > depth").select("conv", "depth", "whole", F.col("saved").alias("all_below"))
    at_whole = below.where((F.col("whole") == F.col("depth")) & own).select("conv", F.col("depth").alias("whole"), F.col("saved").alias("end_below"))
    inner = inner.join(at_whole, ["conv", "whole"]).join(members.select(F.col("owner").alias("conv"), F.col("depth").alias("whole"), "saved", "leaf"), ["conv", "whole"])
    inner = inner.select(F.col("conv").alias("conv_id"), "depth", (F.col("all_below") - F.col("end_below") + F.col("saved")).alias("saved_tokens"), F.col("leaf").alias("n_leaves"))
    lone = below.where("whole IS NULL").select(F.col("conv").alias("conv_id"), "depth", F.lit(0).cast("long").alias("saved_tokens"), F.lit(1).cast("long").alias("n_leaves"))
    summed = members.select(F.col("owner").alias("conv_id"), "depth", F.col("saved").alias("saved_tokens"), F.col("leaf").alias("n_leaves"))
    whole = owned.agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")).first()

    # one aggregate puts a node's parts together
    children = hangs.groupBy(F.col("from_conv").alias("conv_id"), F.col("from_depth").alias("depth")).agg(F.count("*").alias("hanging"))
    parents = hangs.select(F.col("conv").alias("conv_id"), (F.col("from_depth") + 1).alias("depth"), F.col("from_conv").alias("parent_conv_id"))
    basic = nodes.select(F.col("conv").alias("conv_id"), "depth", "n_convs", (F.col("length") > F.col("depth")).cast("long").alias("going_on"))
    parts = basic
    if total:
        going_on = convs.where((F.col("conv") == least) & (F.col("length") > 0)).count()
        childless_root = int(not visits.limit(1).count())
        root = [(least, 0, total, going_on, whole["saved_tokens"] or 0, (whole["n_leaves"] or 0) + childless_root)]
        root = turns.sparkSession.createDataFrame(root, "conv_id long, depth long, n_convs long, going_on long, saved_tokens long, n_leaves long")
        parts = parts.unionByName(root, allowMissingColumns=True)
    for more in (summed, inner, lone, children, parents, ends.select("conv_id", "depth", "ends_sha256")):
        parts = parts.unionByName(more, allowMissingColumns=True)
    got = parts.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in parts.columns if c not in ("conv_id", "depth")])
    return got.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("going_on") + F.coalesce("hanging", F.lit(0))).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
