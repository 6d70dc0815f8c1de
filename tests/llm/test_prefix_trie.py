"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from weekcast.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int"


def _expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved, out = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        ended = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest())
    return out


def _got(df):
    rows = P.trie(P.rebuilt(P.ranked_turns(df))).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def _random(seed, ids, convs, most):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "no conversation", "x", 0)]
    for c in (rng.randrange(ids) for _ in range(convs)):
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", rng.choice(["x", "yy", None, "zzz"]) if rng.random() < 0.2 else "same", "x", 0))
    return rows


@pytest.mark.parametrize("seed, ids, convs, most", [(1, 60, 60, 14), (2, 700, 40, 4), (3, 200, 50, 30)])
def test_trie_equals_plain_prefixes(spark, seed, ids, convs, most):
    rows = _random(seed, ids, convs, most)
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _expected(rows)


def test_chunks_of_running_values_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 3)
    rows = _random(4, 30, 30, 40)
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _expected(rows)


def test_copies_one_conversation_and_none(spark):
    copies = [(100 + c, t, "user", f"turn {t}", "x", 0) for c in range(30) for t in range(9)]
    assert _got(spark.createDataFrame(copies, SCHEMA)) == _expected(copies)
    alone = [(3, t, "user", "", None, None) for t in range(6)]
    assert _got(spark.createDataFrame(alone, SCHEMA)) == _expected(alone)
    assert _got(spark.createDataFrame([], SCHEMA)) == {}


def test_conversations_that_end_up_without_turns(spark):
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lost, 0, "user", "goes", "x", 0)]
    got = _got(spark.createDataFrame(rows, SCHEMA))
    assert got == _expected(rows) == {(lost, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())}
