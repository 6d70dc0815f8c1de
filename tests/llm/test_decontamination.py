import random

from weekcast.llm import decontamination as dc

ITEM = "the committee decided on a second reading of the proposal before the winter session could begin in earnest, said the chair"
SCHEMA = "doc_id long, text string, item int, window string"


def distance(a, b):
    """Least edits of ``a`` against any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def brute(text, item):
    text, item = dc._text(text), dc._text(item)
    return any(distance(w, text) <= dc.edit_budget(len(w)) for _, w in dc.windows(item)) if text else False


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, rng.choice("xyz ")), lambda: out.__setitem__(at, rng.choice("xyz"))])()
    return "".join(out)


def test_search_against_brute_force():
    rng = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for n in range(25)] + [(90, ""), (91, None), (92, "short"), (93, "ten chars!")]
    index = dc.build(items)
    texts = [None, "", "x"]
    for _ in range(60):
        _, item = rng.choice(items[:25])
        at = rng.randrange(max(1, len(item) - 70))
        lead = " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))
        texts.append(f"{lead} {edited(rng, item[at : at + 80], rng.randint(0, 7))} {lead[::-1]}")
    got = {(t, index.items[i]) for t, i, *_ in dc.search(index, texts)}
    want = {(t, n) for t, text in enumerate(texts) for n, item in items if item and len(dc._text(item)) >= dc.Q and brute(text, item)}
    assert got == want


def test_passages_do_not_join_across_documents():
    index = dc.build([(1, ITEM[:64])])
    assert dc.search(index, [ITEM[:32], ITEM[32:64]]) == []
    assert dc.search(index, ["a " + ITEM[:64].upper()])[0][:2] == (0, 0)


def test_matches_and_clean_with_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 150)  # several blocks
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "tiny"), (5, ITEM[::-1])], "item_id int, text string")
    rows = [
        (1, "intro " + ITEM + " outro"), (2, None), (3, ""), (4, "clean words only " * 50), (5, "Intro\n" + ITEM.upper().replace(" ", "  ")), (None, ITEM),
        (1, "intro " + ITEM + " outro"), (7, "pad " * 20_000 + ITEM[20:110]), (8, ITEM[:40]), (9, ITEM[::-1] + ITEM),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = {(r.doc_id, r.item_id): r for r in dc.matches(df, bench).collect()}
    assert set(got) == {(1, 1), (5, 1), (None, 1), (7, 1), (9, 1), (9, 5)}
    assert got[1, 1].start == 6 and got[1, 1].edits == 0 and got[7, 1].start >= 80_000 - dc.WINDOW
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 8]
    assert dc.clean(df, bench.limit(0)).count() == len(rows) and dc.matches(df, bench.limit(0)).count() == 0
    assert dc.clean(df.limit(0), bench).count() == 0 and dc.matches(df.limit(0), bench).count() == 0


def test_registered_query_finds_the_planted_passages(spark):
    from weekcast.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    whole = {(d.doc_id, b.item_id) for d in docs for b in bench if dc._text(b.text) in dc._text(d.text)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_qgram_lemma"](spark, "/root/testdata/sf0.01").collect()}
    assert whole and whole <= got
    texts, items = ({d[0]: d.text for d in rows} for rows in (docs, bench))
    assert all(brute(texts[d], items[b]) for d, b in list(got - whole)[:10])


def test_passages_are_found_from_every_start():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz "
    item = "".join(rng.choice(letters) for _ in range(200))
    item = dc._text(item)
    index = dc.build([(1, item)])
    texts = []
    for start in range(0, len(item) - dc.WINDOW + 1):
        passage = item[start : start + dc.WINDOW]
        texts.append(f"1234567890 {passage} 0987654321")
        texts.append(f"1234567890 {edited(rng, passage, rng.randint(1, 7))} 0987654321")
    got = {t for t, *_ in dc.search(index, texts)}
    assert set(range(0, len(texts), 2)) <= got
    want = set(range(0, len(texts), 2))
    for n in range(1, len(texts), 2):
        near = range(max(0, n // 2 - 7), min(len(item) - dc.WINDOW, n // 2 + 7) + 1)  # starts further off cost over 5 edits here
        if any(distance(item[s : s + dc.WINDOW], dc._text(texts[n])) <= dc.edit_budget(dc.WINDOW) for s in near):
            want.add(n)
    assert got == want


def test_short_items_match_exactly():
    index = dc.build([(1, "forty two"), (2, None), (3, "x1"), (4, "Y2"), (5, ITEM)])
    got = dc.found_in(index, ["It is Forty  Two, x1 and x1", "forty-two", None, "y2", "x", ITEM])
    assert {(t, index.items[i], start, edits) for t, i, _, start, edits in got if index.items[i] != 5} == {(0, 1, 6, 0), (0, 3, 17, 0), (3, 4, 0, 0)}
    assert {index.items[i] for t, i, *_ in got if t == 5} == {5}
    assert dc.found_in(dc.build([(1, "ab")]), ["a", "b", "ab"])[0][:2] == (2, 0)


def test_short_items_in_the_operators(spark):
    bench = spark.createDataFrame([(1, "x1 y2"), (2, ITEM)], "item_id int, text string")
    df = spark.createDataFrame([(1, "some X1  Y2 here", 0, "x"), (2, "some x1y2 here", 0, "x"), (3, None, 0, "x")], SCHEMA)
    assert [tuple(r) for r in dc.matches(df, bench).collect()] == [(1, 1, 1, 5, 0)]
    assert sorted(r.doc_id for r in dc.clean(df, bench).collect()) == [2, 3]
