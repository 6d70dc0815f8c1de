import pytest

from weekcast.llm import url_filters
from weekcast.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def judged(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x?y#z", "http://a.example.org/en/123", "http://example.org/en/2", "http://example.org",
    "http://b.com/de/", "http://b.com/fr/a", "http://com/de/x", "http://.org/x", "http://org/", "http://x.org:80/", "http://Ünï.ORG/ä/b", "http://x.org?q=/es/",
    "http://notorg/a", "http://a.b.c.d.e.f.com/de/1", "ftp://u@h.com/de/2#://", "http://x.org/" + "a" * 5000, "://com/fr/",
]


def test_against_plain_python(spark):
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    rows = [(n, u, "x", 1) for n, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, digest int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, rules).collect()}
    assert got == {n: judged(u, URL_RULES) for n, u in enumerate(URLS)}


def test_repeats_ties_nulls_and_empty_tables(spark):
    rules = [("allow", "a.b", "/"), ("block", "a.b", "/"), ("block", None, "/"), ("allow", "x", ""), ("allow", "a.b", "/")]
    table = spark.createDataFrame(rules, "action string, host string, path string")
    df = spark.createDataFrame([(1, "h://a.b/"), (1, "h://a.b/"), (None, "h://x")], "page_id long, url string")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in url_filters.judge(df, table).collect())
    assert got == [("1", "a.b/", "block"), ("1", "a.b/", "block"), ("None", "x", "allow")]
    assert [r.verdict for r in url_filters.judge(df, table.limit(0)).collect()] == ["allow"] * 3
    assert url_filters.judge(df.limit(0), table).count() == 0
