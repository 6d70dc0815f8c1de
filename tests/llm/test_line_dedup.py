import itertools
import random

import numpy as np

from tests.llm.test_sketches_and_linking import classes_of
from weekcast.llm import line_dedup as ld
from weekcast.llm import linking
from weekcast.llm.sketches import bands, minhash, one_permutation

SCHEMA = "doc_id long, text string, node string, line int"


def brute(rows):
    """The kept lines of every row, by all pairs of distinct lines."""
    keys = {k for i, t in rows if i is not None and t for x in t.split("\n") if (k := ld.line_key(x))}
    links = [p for p in itertools.combinations(sorted(keys), 2) if ld.jaccard(*p) >= ld.THRESHOLD]
    of = {k: k for k in keys} | classes_of(links)
    keeper = {}
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None else []:
            if k := ld.line_key(x):
                keeper[of[k]] = min(keeper.get(of[k], i), i)
    out = []
    for i, t in rows:
        if t is None or i is None:
            out.append(t)
            continue
        kept, told = [], set()
        for x in t.split("\n"):
            k = ld.line_key(x)
            if k and (keeper[of[k]] != i or of[k] in told):
                continue
            told.add(of.get(k))
            kept.append(x)
        out.append("\n".join(kept))
    return out


def test_against_brute_force_with_edge_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(60)]

    def varied(line):
        at = rng.randrange(len(line))
        return rng.choice([line, line.upper(), "  " + line + " ", line[:at] + rng.choice("xyz") + line[at + 1 :], line[:at] + line[at:].replace("a", "q", 1)])

    rows = [(n, "\n".join(varied(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for n in range(60, 0, -1)]
    rows += [(70, None), (71, ""), (72, "\n \n"), (None, pool[0]), (73, "a"), (74, "A\n\nb"), (75, pool[1] * 200), (76, pool[1] * 200 + "!")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    done = ld.dedup(df)
    assert done.columns == [*df.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.node) for r in done.collect()}
    want = dict(zip([i for i, _ in rows], brute(rows)))
    assert {i: g[0] for i, g in got.items()} == want
    for i, t in rows:
        if t is not None:
            count = lambda s: sum(bool(x.strip()) for x in s.split("\n"))
            assert got[i][1] == count(t) and got[i][2] == count(t) - count(want[i]) and got[i][3] == "x"


def test_bands_miss_no_more_pairs_at_the_threshold_than_stated():
    """Pairs of sets of similarity 0.8, of sizes for either sketch: at most (1 - 0.8**5)**24 = 7 in 100,000 share no band."""
    rng = np.random.default_rng(0)
    missed = pairs = 0
    for n in (18, 45, 90, 126, 180, 270, 450):
        shared, own = n * 8 // 9, n // 9
        for _ in range(5):
            all_ = rng.integers(0, 1 << 44, (2000, shared + 2 * own)).astype(np.uint64)
            a, b = np.sort(all_[:, : shared + own], 1), np.sort(np.delete(all_, np.s_[shared : shared + own], 1), 1)
            sketch = one_permutation if n >= ld.REGISTERS else minhash
            sets = np.repeat(np.arange(2000), n)
            x, y = (bands(sketch(sets, s.ravel(), 2000, ld.REGISTERS), ld.BAND_ROWS) for s in (a, b))
            missed, pairs = missed + int((x != y).all(axis=1).sum()), pairs + 2000
    assert missed <= 20, (missed, pairs)  # 5 of 70,000 are expected


def test_shared_shingles_are_those_of_the_strings():
    rng = random.Random(6)
    keys = list({"".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))).strip() or "a" for _ in range(80)})
    keys += ["日本語のテキスト" * 3, "日本語のテキスト", "x" * 50, "x" * 200_000, "x" * 200_000 + "y"]
    lines, shingles = ld.shingle_sets(keys, [ld.fingerprint(k) for k in keys])
    whole = [{k[i : i + ld.SHINGLE] for i in range(max(1, len(k) - ld.SHINGLE + 1))} for k in keys]
    assert np.bincount(lines).tolist() == [len(s) for s in whole]
    pairs = np.array(list(itertools.combinations(range(len(keys)), 2)))
    shared, either = ld.shared_shingles(lines, shingles, pairs[:, 0], pairs[:, 1], len(keys))
    for (i, j), n, m in zip(pairs, shared, either):
        assert (n, m) == (len(whole[i] & whole[j]), len(whole[i] | whole[j])), (keys[i][:60], keys[j][:60])


def test_line_keys_are_those_of_single_lines():
    for text in ["A b\nC", " a  b \n\n", "a\tb\nc", "x\u00a0y\nz", "a\r\nb", "\u3000a", "", "\n", "É è\u2003\n İ"]:
        assert ld.line_keys(text) == [ld.line_key(x) for x in text.split("\n")]


def test_a_hot_group_costs_few_pairs_a_member(spark, monkeypatch):
    """Three hundred variants of one line: at most 15 pairs a member are verified."""
    line = "the quick brown fox jumps over the lazy dog and runs through the wide green field at noon"
    rows = [(n, f"{line[:40]}{n % 50:02d}{line[42:]}{n // 50:02d}") for n in range(300)]
    checked = []
    real = linking.linked

    def counting(members, verify, fits=None, elements=None):
        def counted(pairs):
            checked.append(pairs.count())
            return verify(pairs)

        return real(members, counted, fits, elements)

    monkeypatch.setattr(linking, "linked", counting)
    got = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got if r.text] == [0]
    assert sum(checked) <= 15 * len(rows), checked


def test_lines_that_share_a_passage_but_are_not_alike(spark, monkeypatch):
    """A passage in 150 lines of otherwise own words (similarity about 0.6): few pairs are verified, and the few like lines among them are found."""
    monkeypatch.setattr(linking, "LIGHT", 8)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(30))
    lines = [f"{' '.join(word() for _ in range(5))} {passage} {' '.join(word() for _ in range(4))}" for _ in range(150)]
    lines += [lines[n][:100] + "q" + lines[n][101:] for n in range(0, 60, 5)]
    rows = list(enumerate(lines))
    checked = []
    real = linking.linked

    def counting(members, verify, fits=None, elements=None):
        def counted(pairs):
            checked.append(pairs.count())
            return verify(pairs)

        return real(members, counted, fits, elements)

    monkeypatch.setattr(linking, "linked", counting)
    got = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip(range(len(rows)), brute(rows)))
    assert sum(checked) <= 10 * len(rows), checked


def _family(rng, n, words=90):
    """Variants of one line, most pairs of which are a little less alike than the threshold asks for."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    base, lines = [word() for _ in range(words)], []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.choice([2, 4, 7, 9, 11, 13])):
            own[at] = word()
        lines.append(" ".join(own))
    return lines


def test_variants_not_quite_alike_cost_few_pairs_a_member(spark, monkeypatch):
    """A family of twice the lines has about twice the pairs to verify, and the components are those of all pairs."""
    checked = []
    real = linking.linked

    def counting(members, verify, fits=None, elements=None):
        def counted(pairs):
            checked[-1] += pairs.count()
            return verify(pairs)

        return real(members, counted, fits, elements)

    monkeypatch.setattr(linking, "linked", counting)
    for n in (150, 300):
        rows = list(enumerate(_family(random.Random(17), n)))
        checked.append(0)
        got = [r.text for r in sorted(ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
        assert got == brute(rows)
    assert checked[1] <= 25 * 300 and checked[1] <= 3 * checked[0], checked  # 6,443 and 23,360 by rare elements of the whole lines


def test_counts_of_slots_add_up_over_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(-50, 50, rng.integers(0, 40)).tolist(),) for _ in range(60)]
    got = linking._rarity(spark.createDataFrame(rows, "elements array<long>").repartition(7), "elements")
    want = np.bincount(linking._slots(np.array([x for r, in rows for x in r])), minlength=1 << linking.SLOT_BITS)
    assert (got == want).all()


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "same line here\nother"), (1, "same line here\nother"), (2, "same line here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in ld.dedup(df).collect()) == ["", "same line here\nother", "same line here\nother"]
    assert ld.dedup(df.limit(0)).count() == 0


def test_a_hot_line_and_a_hot_group_of_variants(spark):
    line = "the quick brown fox jumps over the lazy dog and runs through the wide green field at noon"
    rows = [(n, f"{line}\n{line[:60]}{n % 50:02d}{line[62:]}\nown line number {n * 7919} of this document {n}") for n in range(300)]
    got = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [x for r in got for x in r.text.split("\n") if "fox" in x]
    assert len(kept) == 1
