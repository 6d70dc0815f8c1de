import itertools
import random

import numpy as np

from weekcast.llm import linking
from weekcast.llm.near_documents import probability_jaccard
from weekcast.llm.sketches import bands, minhash, prob_minhash


def plain_probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})


def test_probability_jaccard_is_the_definition():
    rng = random.Random(2)
    for _ in range(200):
        x, y = ({rng.randrange(12): rng.randint(1, 5) for _ in range(rng.randint(1, 9))} for _ in range(2))
        arrays = [np.array(v) for d in (x, y) for v in zip(*sorted(d.items()))]
        assert np.isclose(probability_jaccard(*arrays), plain_probability_jaccard(x, y))


def test_registers_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    x = rng.integers(1, 6, 60)
    keep = rng.random(60) < 0.8
    b, y = a[keep], x[keep] + (rng.random(keep.sum()) < 0.2)
    m = 4096
    sets = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    got = prob_minhash(sets, np.concatenate([a, b]), np.concatenate([x, y]), 2, m)
    ia, ib = np.argsort(a), np.argsort(b)
    assert abs((got[0] == got[1]).mean() - probability_jaccard(a[ia], x[ia], b[ib], y[ib])) < 0.03
    scaled = prob_minhash(np.zeros(len(a), int), a, 7 * x, 1, m)
    assert (scaled[0] == got[0]).mean() > 0.999
    plain = minhash(sets, np.concatenate([a, b]), 2, m)
    assert abs((plain[0] == plain[1]).mean() - keep.mean()) < 0.03


def test_small_sets_fill_their_registers():
    one = minhash(np.array([0, 1, 1]), np.array([5, 5, 5], np.uint64), 2, 40)
    assert (one[0] == one[1]).all() and len(np.unique(one[0])) > 1
    assert bands(one, 4).shape == (2, 10)
    assert (prob_minhash(np.array([0]), np.array([9], np.uint64), np.array([1]), 1, 96) == 9).all()


def classes_of(edges):
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in list(parent)}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 540)] + [(900, 900 + i) for i in range(1, 30)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.class_id for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == classes_of(edges)
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_loses_no_class_and_checks_few_pairs(spark):
    """Nodes on a line, linked up to a distance: in one bucket, most pairs are not similar."""
    places = {n: n * 3 + n // 40 * 50 for n in range(160)}  # four runs of 40
    members = spark.createDataFrame([(b, n) for n in places for b in (7, 8)] + [(9, 3), (9, 150)], "bucket long, node long")
    checked = []

    def verify(pairs):
        rows = [(r.a, r.b) for r in pairs.collect()]
        checked.extend(rows)
        return spark.createDataFrame([(a, b) for a, b in rows if abs(places[a] - places[b]) <= 30], "a long, b long")

    links = [(r.a, r.b) for r in linking.linked(members, verify).collect()]
    got = classes_of(links)
    want = classes_of([p for p in itertools.combinations(places, 2) if abs(places[p[0]] - places[p[1]]) <= 30])
    assert got == want
    assert len(checked) == len(set(checked))


def test_buckets_of_the_same_nodes_are_kept_once(spark):
    """Of 24 buckets of the same two nodes one is left, and none of another set of nodes is lost."""
    rng = random.Random(12)
    same = [rng.getrandbits(63) for _ in range(24)]
    some = [rng.getrandbits(63) for _ in range(3)]
    rows = [(1, [*same, some[0]]), (2, [*same, some[0], some[1]]), (3, [*some, 5]), (4, [some[1], some[2], 6]), (5, [7]), (None, same), (6, None)]
    found = {}
    for r in linking.shared_buckets(spark.createDataFrame(rows, "node long, bands array<long>")).collect():
        found.setdefault(r.bucket, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [[1, 2], [1, 2, 3], [2, 3, 4], [3, 4]]


def test_filter_holds_its_keys(spark):
    keys = spark.createDataFrame([(k,) for k in (-5, 0, 7, 1 << 62, -(1 << 63))], "key long")
    bits = linking.filter_of(keys, "key")
    assert linking.may_hold(bits, np.array([-5, 0, 7, 1 << 62, -(1 << 63)])).all()
    assert not linking.may_hold(bits, np.array([1, 2, 3])).any()


def test_components_over_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(linking, "CHUNK_EDGES", 8)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(200)]
    edges = [e for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    got = {r.node: r.class_id for r in linking.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == classes_of(edges)
