import itertools
import random

from tests.llm.test_sketches_and_linking import classes_of, plain_probability_jaccard
from weekcast.llm import near_documents as nd

SCHEMA = "doc_id long, text string, node string, bands int"


def plain_shingles(text):
    words = (text or "").lower().split()
    runs = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return {r: runs.count(r) for r in runs}


def brute(rows):
    shingles = [plain_shingles(t) for _, t in rows]
    links = []
    for (i, x), (j, y) in itertools.combinations([(n, s) for n, s in enumerate(shingles) if s and rows[n][0] is not None], 2):
        if rows[i][0] == rows[j][0] or plain_probability_jaccard(x, y) >= nd.THRESHOLD:
            links.append((rows[i][0], rows[j][0]))
    found = classes_of(links)
    return {i: found.get(i, i) for i, _ in rows}


def made(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()) + str(rng.randrange(40)) for _ in range(n))


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(1000))
    return " ".join(words)


def test_against_brute_force_with_edge_rows(spark):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (7, "x " * 300), (8, "x " * 301)]
    base = made(rng, 150)
    rows += [(100 + n, changed(rng, base, rng.randint(0, 6))) for n in range(40)]  # chains of near copies
    for n in range(20):
        text = made(rng, rng.randint(5, 200))
        rows += [(200 + 4 * n, text), (201 + 4 * n, text.upper()), (202 + 4 * n, changed(rng, text, 1)), (203 + 4 * n, changed(rng, text, len(text.split()) // 6))]
    rows += [(4, "one two"), (900, made(rng, 4000))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [(r.doc_id, r.class_id) for r in nd.classes(df).collect()]
    assert len(got) == len(rows)
    want = brute(rows)
    want[None] = None
    assert {i: c for i, c in got} == want


def test_families_of_variants_with_repeated_parts(spark, monkeypatch):
    """Variants of two texts, in one family with passages that come several times, in buckets that count as large."""
    from weekcast.llm import linking

    monkeypatch.setattr(linking, "LIGHT", 4)
    rng = random.Random(23)
    for copies in (1, 4):
        base = made(rng, 80)
        rows = []
        for n in range(70):
            text = " ".join(changed(rng, base, rng.choice([0, 1, 2, 3])) for _ in range(rng.choice([1, copies])))
            rows.append((n, text + " again and again and again and" * rng.choice([0, 0, 3, 12])))
        got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows)


def test_texts_that_share_only_a_long_repetition(spark, monkeypatch):
    """Texts of other words each behind the same words many times: similar only where both have few others, and few pairs are verified."""
    from weekcast.llm import linking

    monkeypatch.setattr(linking, "LIGHT", 4)
    verified, whole = [], linking.linked

    def counted(members, verify, *more):
        def told(pairs):
            verified.append(pairs.count())
            return verify(pairs)

        return whole(members, told, *more)

    monkeypatch.setattr(linking, "linked", counted)
    rng = random.Random(31)
    rows = [(0, made(rng, 125) + " is on" * 300)]
    rows += [(n, made(rng, rng.choice([20, 60, 90, 100, 110, 125, 145, 170])) + " is on" * rng.choice([300, 300, 30, 250])) for n in range(1, 130)]
    rows += [(n, "more " * (n % 7) + made(rng, 100) + " is on" * 3) for n in range(130, 150)]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(verified) < 8 * len(rows)


def test_an_id_with_several_texts_ties_them(spark):
    rng = random.Random(3)
    a, b = made(rng, 60), made(rng, 60)
    df = spark.createDataFrame([(5, a), (6, b), (1, a), (5, b)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in nd.classes(df).collect()} == {(5, 1), (6, 1), (1, 1)}


def test_keep_one_of_each_class(spark):
    rng = random.Random(5)
    a, b = made(rng, 80), made(rng, 80)
    rows = [(2, a, "s", 1), (1, a + " end", "t", 2), (3, b, "u", 3), (3, b, "u", 3), (None, a, "v", 4), (8, None, "w", 5), (9, "", "w", 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.node) for r in kept.collect()) == [("1", "t"), ("3", "u"), ("8", "w"), ("9", "w"), ("None", "v")]
    assert nd.keep_one(df.limit(0)).count() == 0


def test_registered_query_against_brute_force(spark):
    from weekcast.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.class_id for r in QUERIES["op1_prob_minhash"](spark, "/root/testdata/sf0.001").collect()}
    weights = {d.doc_id: nd.weighted_shingles(d.text) for d in docs}
    links = [(i, j) for i, j in itertools.combinations(weights, 2) if len(weights[i][0]) and nd.probability_jaccard(*weights[i], *weights[j]) >= nd.THRESHOLD]
    found = classes_of(links)
    assert got == {i: found.get(i, i) for i in weights}
