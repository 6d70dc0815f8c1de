import numpy as np

from weekcast.llm import quality as q

SF = "/root/testdata/sf0.1"


def test_figures_of_plain_texts():
    names = list(q.HEURISTICS)
    found = dict(zip(names, q.looked_at("Go go GO! go | x")[0]))
    assert found["repeats"] == 0 and found["bars"] == 1 / 6 and found["shouts"] == 1 / 6 and found["capitals"] == 3 / 9
    assert q.looked_at("a a a a")[0][names.index("repeats")] == 3 / 4
    assert q.looked_at(None) is None and q.looked_at(" \n\t") is None
    low, high = (q.looked_at(t)[1] for t in ("Losers, the", "losers the"))
    assert len(np.intersect1d(low, high)) >= 3  # words and beginnings


def test_expectation_maximisation_recovers_the_labellers():
    rng = np.random.default_rng(1)
    n, k = 6000, len(q.LABELLERS)
    good = rng.random(n) < 0.8
    votes = np.zeros((n, k), np.int8)
    content = ~good & (rng.random(n) < 0.5)
    for j in range(k):
        if q.LABELLERS[j] in ("lexicon", "person_content"):
            hit = content & (rng.random(n) < 0.9) | (good & (rng.random(n) < 0.01))
        else:
            hit = ~good & ~content & (rng.random(n) < 0.6) | (good & (rng.random(n) < 0.01))
        votes[:, j] = np.where(hit, 1, -1 if j < len(q.HEURISTICS) else 0)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    chance, rates = q.expectation_maximisation(patterns, counts.astype(float))
    assert ((chance[place.ravel()] >= 0.5) == good).mean() > 0.97
    assert rates[0].max() < 0.05 and rates[1].min() > 0.2


def test_held_out_accuracy_and_toxic_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.where("doc_id % 4 <> 0")
    model = q.fit(docs, known)
    held = labels.where("doc_id % 4 = 0").join(docs, "doc_id").collect()
    rows = [(r.quality, r.toxic, model.score(r.text) >= q.KEEP) for r in held if r.text]
    clean = [k for g, t, k in rows if g == 1 and t == 0]
    toxic = [k for g, t, k in rows if t == 1]
    poor = [k for g, t, k in rows if g == 0]
    assert np.mean(clean) > 0.97 and np.mean(toxic) < 0.15 and np.mean(poor) < 0.1


def test_edge_rows(spark):
    good = [(n, f"The {w} walked to the old house near the river, and it was {w} again. Nobody knew why.") for n, w in enumerate("red blue tall small odd kind brave quiet".split() * 4)]
    poor = [(100 + n, "$$$ %%% ### " * 20) for n in range(8)]
    rows = good + poor + [(200, None), (201, ""), (202, "  "), (None, good[0][1]), (0, good[0][1]), (300, "word. " * 100_000)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, id string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (100, 0, 0), (None, 1, 0), (1, None, 1), (2, 1, 0), (101, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = q.fit(df, labels)
    got = q.scored(df, model).collect()
    assert len(got) == len(rows)
    verdict = {r.doc_id: r.keep for r in got}
    assert all(verdict[i] for i, _ in good) and not any(verdict[i] for i, _ in poor) and verdict[None]
    assert [r.score for r in got if r.doc_id in (200, 201, 202)] == [0.0] * 3
    kept = q.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}
    assert all(r.keep for r in q.scored(df.where("doc_id < 50"), q.fit(df, labels.limit(0))).collect())
    assert q.scored(df.limit(0), q.fit(df.limit(0), labels)).count() == 0
