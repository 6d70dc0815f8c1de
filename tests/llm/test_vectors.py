import numpy as np
from pyspark.sql import functions as F

from weekcast.llm import vectors


def brute(ids, x, query, k):
    scores = np.einsum("ij,j->i", x, x[query])
    keep = ids != ids[query]
    order = np.lexsort((ids[keep], -scores[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), scores[keep][order].tolist()))


def made(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_recall_on_vectors_of_unequal_length(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))) * rng.uniform(0.5, 2, 3000)[:, None]
    x = x.astype(np.float32).astype(float)
    ids = np.arange(3000) * 2
    got = {}
    for r in vectors.search(made(spark, ids, x), F.col("id") % 100 == 0, k=10, n_pivots=256, n_places=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 3000, 50):
        want = brute(ids, x, q, 10)
        found = sorted(got[int(ids[q])])
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        hits += len({w[0] for w in want} & {f[1] for f in found})
        total += 10
    assert hits / total >= 0.9


def test_invalid_vectors_ties_and_repeats(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
        (8, [1.0]), (9, [0.0, 1.0]), (2, [2.0, 0.0]), (None, [5.0, 5.0]), (10, []),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, order int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vectors.search(df, F.col("id") % 5 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 9, 0.0)]
    assert vectors.search(df.limit(0), F.col("id") % 5 == 0).count() == 0
    assert vectors.search(df.where("vec_id = 3"), F.col("id") % 3 == 0).count() == 0


def test_many_equal_vectors_keep_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST", 10)
    ids = np.arange(400)
    x = np.vstack([np.tile([1.0, 2.0, 3.0], (200, 1)), np.random.default_rng(1).normal(size=(200, 3))])
    got = vectors.search(made(spark, ids, x), F.col("id") == 0, k=20, share=0.1).orderBy("rank").collect()
    assert [r.vec_id for r in got][:5] == [r.vec_id for r in sorted(got, key=lambda r: (-r.score, r.vec_id))][:5]
    ties = [r.vec_id for r in got if r.score == 14.0]
    assert ties == list(range(1, len(ties) + 1))


def test_registered_query_recall(spark):
    from weekcast.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = {}
    for r in QUERIES["op2_permutation_index"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[queries].tolist())
    hits = [len(got[int(ids[q])] & {w[0] for w in brute(ids, x, q, 20)}) / 20 for q in queries]
    assert np.mean(hits) >= 0.9
