"""Reply trees as training conversations, with DataFrame functions only (no Python on the executors).

Messages name the message that they answer. Every path from a root to a leaf of a tree is one
conversation. Paths are enumerated by iterative self-joins that double their reach: round k joins the
table of ancestors 2**k above with itself, so a thread of a million replies takes 20 rounds, and a
message drops out as soon as it has no ancestor that far up. From each leaf the paths are then laid
out top round first, every found (path, message) doubling what is known of the path; the rows made are
the rows of the paths and no more. Only ids and scores travel in these joins; texts join last.

Branches of a tree are ranked by the sum of their messages' scores (ties: the smaller leaf id), and
the ``best`` of them are formatted, or all.

Template: ``<|im_start|>role``, a new line, the text, ``<|im_end|>``, a new line, for every message. Inside
texts one backslash is put into whatever would read ``<|``, with any number of backslashes between,
so no text can hold a control string and each comes back exactly; in roles ``%``, ``<`` and new lines
are written as ``%25``, ``%3C`` and ``%0A``. A conversation is a list of segments, each under the loss mask or
not; joined they are the formatted string. Under the mask are the texts of the assistant, nothing else.

Defined cases: null roles, texts and scores are empty, empty and 0; rows without a message id take
no part; a null tree id is a tree of its own; rows that repeat a message id count once (the least by
parent, role, text and score); a parent that isn't in the tree makes its child a root; messages on a
cycle of parents, and those that answer to one, hang from no root and take no part; empty texts are
turns; an empty table gives an empty result; other columns are ignored. A formatted conversation is
one value, so a single path is gathered in one row (2 GB at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, written

START, END, ROLE_UNDER_LOSS = "<|im_start|>", "<|im_end|>", "assistant"

SEGMENT = "struct<text:string,loss:boolean>"


def escaped(text: Column) -> Column:
    """The text without control strings: ``<|`` reads ``<\\|``, ``<\\|`` reads ``<\\\\|`` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


_ROLE_CODES = [("%", "%25"), ("<", "%3C"), ("\n", "%0A")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped_role(role: Column) -> Column:
    return _replaced(role, _ROLE_CODES)


def unescaped_role(role: Column) -> Column:
    return _replaced(role, [(new, old) for old, new in reversed(_ROLE_CODES)])


def threads(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Messages of conversations that are plain lists of turns: each answers the one before in ``order``
    (nulls first; ties by role and text), ids counting from 1."""
    turn = Window.partitionBy(tree).orderBy(F.asc_nulls_first(order), role, text)
    number = F.row_number().over(turn).cast("long")
    found = rows.select(F.col(tree).alias("tree"), number.alias("id"), F.col(role).alias("role"), F.col(text).alias("text"))
    return found.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _messages(messages: DataFrame, unique: bool) -> DataFrame:
    """The written messages, one row an id, with a key of tree and id that is never null."""
    rest = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    once = messages.where("id IS NOT NULL").select("tree", "id", rest.alias("rest"))
    if not unique:
        once = once.groupBy("tree", "id").agg(F.min("rest").alias("rest"))
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("t"), F.col("tree").isNull().alias("z"), F.col(c).alias("m")))
    once = once.select("tree", "id", "rest.*").withColumn("node", key("id")).withColumn("up", key("parent"))
    return written(once.select("tree", "id", "node", "up", "role", "text", "score"), "messages")


def _ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables k = 0, 1, ... of (node, up, gain): the ancestor 2**k above and the scores passed on the way,
    the node's own included; and the nodes of no root, if any (their ancestors never end)."""
    heads = messages.select(F.col("node").alias("up"))
    tables = [written(messages.select("node", "up", F.col("score").alias("gain")).where("up IS NOT NULL").join(heads, "up", "left_semi").select("node", "up", "gain"), "ancestors-0")]
    longest = messages.count().bit_length()
    while not tables[-1].isEmpty():
        if len(tables) > longest:  # an ancestor further up than there are messages
            return tables[:-1], tables[-1].select("node")
        last = tables[-1]
        further = last.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("gain2"))
        tables.append(written(last.join(further, "up").select("node", F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain")), f"ancestors-{len(tables)}"))
    return tables, None


def paths(messages: DataFrame, best: int | None = None, unique: bool = False) -> DataFrame:
    """``tree``, ``branch`` (rank from 1 if ``best`` is given, else null), ``leaf`` (its id), ``path_score`` and
    ``turns``, an array of (role, text) from the root on, of every path from a root to a leaf, or of the
    ``best`` ones of each tree.

    ``messages`` has tree, id, parent, role, text and score; ``unique`` says that no (tree, id) repeats.
    """
    known = _messages(messages, unique)
    tables, endless = _ancestors(known)
    nodes = known.select("tree", "id", "node", "score")
    leaves = nodes.join(tables[0].select(F.col("up").alias("node")), "node", "left_anti")
    if endless is not None:
        leaves = leaves.join(endless, "node", "left_anti")
    # the sum from the leaf up to its root: whole jumps, the farthest first; what is left is the root's own score
    tops = leaves.select("tree", "id", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("path_score"))
    for table in reversed(tables):
        jump = table.select("node", F.col("up").alias("to"), "gain")
        tops = tops.join(jump, "node", "left").select("tree", "id", "leaf", F.coalesce("to", "node").alias("node"), (F.col("path_score") + F.coalesce("gain", F.lit(0.0))).alias("path_score"))
    tops = tops.join(nodes.select("node", F.col("score").alias("own")), "node")
    tops = tops.select("tree", "id", "leaf", (F.col("path_score") + F.col("own")).alias("path_score"))
    rank = F.lit(None).cast("int")
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "id"))
    tops = tops.withColumn("branch", rank)
    tops = written(tops if best is None else tops.where(F.col("branch") <= best), "branches")
    # every path from its leaf up: with table k, what is known of it (multiples of 2**(k + 1) above the leaf) doubles
    steps = written(tops.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height")), "path-steps")
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].select("node", F.col("up").alias("to"))
        more = steps.join(jump, "node").select("leaf", F.col("to").alias("node"), (F.col("height") + (1 << k)).alias("height"))
        wider = written(steps.unionByName(more), "path-steps")
        dropped(steps)
        steps = wider
    turns = steps.join(known.select("node", "role", "text"), "node").groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct(F.negative("height").alias("depth"), "role", "text"))).alias("turns")
    )
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return tops.join(turns, "leaf").select("tree", "branch", F.col("id").alias("leaf"), "path_score", "turns")


def formatted(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """The rows with ``segments`` instead of ``turns`` (role, text): text and whether it is under the loss mask."""

    def segments(turn: Column) -> Column:
        head = F.concat(F.lit(START), escaped_role(turn["role"]), F.lit("\n"))
        loss = turn["role"] == ROLE_UNDER_LOSS
        return F.array(*[F.struct(t.alias("text"), x.alias("loss")) for t, x in ((head, F.lit(False)), (escaped(turn["text"]), loss), (F.lit(END + "\n"), F.lit(False)))])

    return conversations.withColumn("segments", F.flatten(F.transform(turns, segments))).drop(turns)


def read_back(rows: DataFrame) -> DataFrame:
    """Formatted rows with ``formatted`` (the string), ``turns`` parsed from it and ``loss_text``, what the mask covers."""
    whole = rows.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))

    def parsed(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece) - F.length(head) - len(END) - 2)
        return F.struct(unescaped_role(head).alias("role"), unescaped(body).alias("text"))

    pieces = F.split("formatted", r"<\|im_start\|>")
    covered = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return whole.withColumn("turns", F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), parsed)).withColumn("loss_text", F.array_join(covered, ""))


def digests(rows: DataFrame) -> DataFrame:
    """``tree``, ``branch``, ``leaf`` and what was read back of each formatted conversation, as counts and SHA-256 digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(rows).select(
        "tree",
        "branch",
        "leaf",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
