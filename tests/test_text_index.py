"""The trigram index against the full scan."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekcast.operators import text_index as ti
from weekcast.operators.explore import text_search

PATTERNS = ["PROMO", "promo bur", "BURNISHED.*COPPER", "stan+ard", "colou?r", "ab{0,2}cde", "x+yz1", "a.b", "ab", "", "cat|dog", "(cat)", "[ab]cdefg", "fox\\.com",
            "\\d+ items", "^green", "green$", "grün", "GRÜN", "no such words anywhere", "item 1", "\\bcat\\b", "a\\+b=c", "12.5"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rnd = random.Random(1)
    words = ["promo", "BURNISHED", "copper", "Standard", "color", "colour", "abcde", "acde", "xxyz1", "cat", "dog", "catalog", "bcdefg", "fox.com", "foxxcom", "grün", "GRÜN", "GREEN", "a+b=c", "7 items", "ab"]
    rows = [(n, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) if rnd.random() < 0.95 else None, rnd.random() < 0.5, round(rnd.uniform(0, 20), 1)) for n in range(400)]
    df = spark.createDataFrame(rows, "id int, words string, flag boolean, price double").repartition(5)
    path = str(tmp_path_factory.mktemp("index"))
    ti.build(df, path)
    return df, path


def test_search_equals_the_full_scan(spark, indexed):
    df, path = indexed
    for pattern in PATTERNS:
        got, want = (sorted(map(str, x.collect())) for x in (ti.search(spark, path, pattern), text_search(df, pattern)))
        assert got == want, pattern


def test_rare_words_read_few_rows(spark, indexed):
    df, path = indexed
    assert ti.candidates(spark, path, "fox\\.com").count() == text_search(df, "fox\\.com").count()
    assert ti.candidates(spark, path, "no such words anywhere").count() == 0
    assert ti.candidates(spark, path, "cat|dog") is None and ti.candidates(spark, path, "ab") is None


def test_runs_that_every_match_holds():
    assert ti.required_runs("stan+ard") == ["stan", "ard"]
    assert ti.required_runs("colou?r") == ["colo"] and ti.required_runs("abc{0,2}def") == ["def"]
    assert ti.required_runs("a\\.bcd") == ["a.bcd"] and ti.required_runs("\\Qabc\\E") == ti.required_runs("\\x41bcd") == [] and ti.required_runs("abc[d-f]ghi") == ["abc", "ghi"]
    assert ti.required_grams("ABCD") == ["abc", "bcd"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["abc", "d", "e?", "f*", "g+", ".", "[hi]", "\\.", "j{0,1}", "k{2}", "^", "lmn"]), max_size=8), st.randoms())
def test_every_match_holds_the_runs(parts, rnd):
    """A text made to match holds every run."""
    pattern = "".join(parts)
    made = {"e?": ["", "e"], "f*": ["", "f", "ff"], "g+": ["g", "gg"], ".": ["z"], "[hi]": ["h", "i"], "\\.": ["."], "j{0,1}": ["", "j"], "k{2}": ["kk"], "^": [""]}
    text = "".join(rnd.choice(made.get(p, [p])) for p in parts)
    if re.search(pattern, text):
        assert all(run in text for run in ti.required_runs(pattern))


def _brute(rows):
    """The rows of every trigram, by substrings."""
    found = {}
    for n, texts in rows:
        for t in texts:
            small = (t or "").translate(ti._TO_SMALL)
            for i in range(len(small) - 2):
                found.setdefault(small[i : i + 3], set()).add(n)
    return found


def test_postings_are_those_of_the_substrings(spark, tmp_path, monkeypatch):
    """Several columns, blocks and slices; characters beyond 16 bits; texts of fewer characters than a trigram."""
    monkeypatch.setattr(ti, "BLOCK", 16)
    monkeypatch.setattr(ti, "SLICE_BYTES", 60)
    rnd = random.Random(5)
    text = lambda: rnd.choice([None, "", "ab", "é", "".join(rnd.choice("abABé😀\n ") for _ in range(rnd.randint(1, 30)))])
    df = spark.createDataFrame([(text(), text(), n) for n in range(90)], "a string, b string, n int").repartition(3)
    ti.build(df, str(tmp_path), ["a", "b", "n"])
    rows = [(r._row, (r.a, r.b, str(r.n))) for r in spark.read.parquet(f"{tmp_path}/rows").collect()]
    posts = spark.read.parquet(f"{tmp_path}/postings").collect()
    pairs = [(p.gram, p.block * 16 + place) for p in posts for place in p.rows]
    want = _brute(rows)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(g, n) for g, held in want.items() for n in held}
    assert {r.gram: r.n for r in spark.read.parquet(f"{tmp_path}/grams").collect()} == {g: len(held) for g, held in want.items()}


def test_postings_are_made_without_a_shuffle(spark):
    df = spark.range(5).selectExpr("id AS _row", "'some words' AS words")
    plan = ti._posted(df, ["words"]).sortWithinPartitions("gram", "block")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "explode" not in plan.lower()


def test_postings_of_more_characters_than_fit_beside_the_rows():
    letters = [chr(c) for c in range(0x100, 0x20000) if not 0xD800 <= c < 0xE000]
    rows = [(n, ("".join(letters[n * 10 : n * 10 + 10]) + "same", "same")) for n in range(9000)]
    code, ends, held = ti._postings([t for _, texts in rows for t in texts], np.repeat(np.arange(9000), 2))
    got = {g: set(part.tolist()) for g, part in zip(ti._strings(code), np.split(held, ends[:-1]))}
    assert len(held) == sum(map(len, got.values())) and got == _brute(rows)
