import random
import re
import time

from weekcast.llm import licenses as li

SCHEMA = "doc_id long, text string, row int, window string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def runs(ws):
    return [tuple(ws[i : i + li.SHINGLE]) for i in range(len(ws) - li.SHINGLE + 1)]


def held(text, notice):
    """The best share of the notice's shingles in any stretch of the text of the notice's length."""
    own, all_ = set(runs(words(notice))), runs(words(text))
    size = len(words(notice)) - li.SHINGLE + 1
    return max((len(own & set(all_[i : i + size])) / len(own) for i in range(max(1, len(all_) - size + 1))), default=0) if own and all_ else 0


def test_notices_in_texts(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice("under the license version work is software permission free public this".split()) + rng.choice(["", "s", "x"]) for _ in range(n))
    rows, want = [], set()
    for n, (name, notice) in enumerate(li.TEMPLATES):
        rows.append((n, f"{noise(rng.randint(0, 60))}\n{notice.upper() if n % 2 else notice}\n{noise(rng.randint(0, 60))}"))
        want.add((n, name))
    rows += [(1100, None), (1101, ""), (1102, "two words"), (None, "All rights reserved."), (1103, noise(5000)), (1104, noise(30_000) + " all rights reserved " + noise(9))]
    rows += [(0, rows[0][1])]
    got = {(r.doc_id, r.license): r for r in li.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), li.templates(spark)).collect()}
    assert want <= set(got) and (1104, "all-rights-reserved") in got
    assert all(got[w].containment >= li.CONTAINMENT for w in want)
    texts = dict(rows[:-1])
    for (i, name), r in got.items():
        assert i is not None
        assert max(held(texts[i], notice) for n, notice in li.TEMPLATES if n == name) >= li.CONTAINMENT
    assert got[1104, "all-rights-reserved"].first_word >= 29_990


def test_a_misread_notice_gives_way(spark):
    df = spark.createDataFrame([(1, "x y z. " + dict((n, t) for n, t in reversed(li.TEMPLATES))["GPL-3.0"] + " a b c d e f g h")], "doc_id long, text string")
    assert [r.license for r in li.scan(df, li.templates(spark)).collect()] == ["GPL-3.0"]


def test_identifiers_titles_and_passages(spark):
    lines = {
        "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0\nimport os",
        "GPL-2.0-or-later": "/* SPDX-License-Identifier: GPL-2.0-or-later */",
        "MIT": "some words\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT",
        "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/",
        "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0. (See accompanying file",
        "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    }
    rows = list(enumerate(lines.values()))
    got = {(r.doc_id, r.license) for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string"), li.templates(spark)).collect()}
    assert {(n, name) for n, name in enumerate(lines)} <= got
    assert all(max(held(rows[i][1], notice) for n, notice in li.TEMPLATES if n == name) >= li.CONTAINMENT for i, name in got)


def test_a_text_of_many_notices_takes_time_in_proportion(spark):
    """Four times the notices, at most about four times the time (seven, for timers' sake)."""
    notices = li.templates(spark)

    def seconds(n):
        df = spark.createDataFrame([(1, "all rights reserved by us " * (n // 5))], "doc_id long, text string")
        start = time.time()
        found = li.scan(df, notices).collect()
        assert [(r.license, r.first_word) for r in found] == [("all-rights-reserved", 0)]
        return time.time() - start

    seconds(500)
    short, long = seconds(3_000), seconds(12_000)
    assert long < 7 * short + 5, (short, long)


def test_empty_tables_and_odd_notices(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    notices = spark.createDataFrame([("a", None), ("b", ""), ("c", "two words"), (None, "all rights reserved"), ("d", "All rights reserved"), ("d", "All rights reserved")], "name string, text string")
    assert [(r.doc_id, r.license, r.containment) for r in li.scan(df, notices).collect()] == [(1, "d", 1.0)]
    assert li.scan(df, notices.limit(3)).count() == 0 and li.scan(df.limit(0), notices).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    plan = li.scan(df, li.templates(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_registered_query_against_brute_force(spark):
    from weekcast.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {(r.doc_id, r.license) for r in QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    exact = {(i, name) for i, t in docs.items() for name, notice in li.TEMPLATES if " ".join(words(notice)) in " ".join(words(t))}
    assert exact and exact <= got
    assert all(max(held(docs[i], notice) for n, notice in li.TEMPLATES if n == name) >= li.CONTAINMENT for i, name in got)
