import html as entities
import math
import re
from collections import defaultdict

from weekcast.llm import html_text as ht

SCHEMA = "page_id long, url string, html string, host string, branches int"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_named_parts_go_and_the_article_stays():
    body = (
        "<header>Site</header><nav><ul><li>Home</ul></nav><div class='cookie-notice'>Cookies!</div><main><article><header><h1>Title &amp; more</h1></header>"
        "<p>First <b>bo</b>ld&nbsp;word<br>next\n line<p>Second<script>var x='</p>'</script> par<form>Your mail <input></form><aside>See also</aside>"
        "<div class='advert'>Buy</div><table><tr><td>a<td>b</table><ul><li>one<li>two</ul><footer>by me</footer></article></main>"
        "<section id='comments'><article class='comment'>Nice!</article></section><div class=sidebar>Links</div><footer>&copy;</footer><!-- x --><style>p{}</style>"
    )
    assert ht.main_text(page(body), set()) == "Title & more First bold word next line Second par a b one two"


def test_lenient_reading():
    assert ht.main_text("<article><p>a < b &lt; c<p>d</article", set()) == "a < b < c d"
    assert ht.main_text("plain text &eacute;&#33;", set()) == "plain text é!"
    assert ht.main_text("<p>a<script>never closed <p>b", set()) == "a"
    assert ht.main_text('<div title="a > b">x</div><p title=\'>\'>y<i>z</i></p></div></p>', set()) == "x yz"
    assert ht.main_text("<p>" + "<b>" * 3000 + "deep", set()) == "deep"
    assert ht.main_text(None, set()) == "" and ht.main_text("", set()) == "" and ht.main_text("<", set()) == "<"
    assert ht.main_text("<div class='has-sidebar'>kept</div><body class='menu'>too", set()) == "kept too"


def composite(pages, path):
    """The importance of a path by the definition, from the pages that hold it."""
    shapes, texts = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for n, p in enumerate(pages):
        for where, kind, feature in ht.features(p):
            if kind == "s" and where == path:
                shapes[feature].add(n)
    holders = defaultdict(set)
    for n, p in enumerate(pages):
        for where, kind, feature in ht.features(p):
            if kind == "s":
                holders[where].add(n)
            if kind == "t" and (where == path or where.startswith(path + "/")):
                texts[where][feature].add(n)
    m = len(holders[path])
    node = -sum(len(s) / m * math.log(len(s) / m, m) for s in shapes.values()) if m > 1 else 1
    spreads = [math.log(len(s), len(holders[w])) if len(holders[w]) > 1 else 0 for w, own in texts.items() for s in own.values()]
    weight = ht.GAMMA ** len(shapes)
    return (1 - weight) * node + weight * (1 - sum(spreads) / len(spreads)), m


def test_style_tree_against_the_definition(spark):
    pages = []
    for n in range(8):
        rows = "".join(f"<li>item {k}" for k in range(n % 3 + 1))
        pages.append(page(
            f"<div class=top>Our site <a>Home</a></div><div class=body{n}><p>Own text {n} of page</p><p>and {n * n} more</p></div>"
            f"<div class=list><ul>{rows}</ul></div><div class=bottom><span>Imprint</span></div>"
        ))
    paths = {p for x in pages for p, _, _ in ht.features(x)}
    want = set()
    for path in paths:
        if any(k == "t" and (w == path or w.startswith(path + "/")) for x in pages for w, k, _ in ht.features(x)):
            value, m = composite(pages, path)
            if m > 1 and value < ht.THRESHOLD:
                want.add(path)
    df = spark.createDataFrame([(n, "http://h/x", x) for n, x in enumerate(pages)] + [(99, "http://h/x", pages[0])], "page_id long, url string, html string")
    got = ht.branches_of(df).collect()
    assert len(got) == 1 and got[0].host == "h" and set(got[0].branches) == want
    assert any(p.endswith("div.top") for p in want) and not any("body0" in p for p in want)
    texts = {r.page_id: r.text for r in ht.extract(df).collect()}
    for n in range(8):
        assert f"Own text {n} of page and {n * n} more" in texts[n] and "Our site" not in texts[n] and "Imprint" not in texts[n]


def test_copies_of_an_article_are_not_template(spark):
    pages = [page(f"<article><h1>Same</h1><p>The very same text here</p></article><div>{n}</div>") for n in range(6)]
    df = spark.createDataFrame([(n, "http://h/", x) for n, x in enumerate(pages)], "page_id long, url string, html string")
    assert {r.text for r in ht.extract(df).collect()} == {"Same The very same text here"}


def test_edge_rows(spark):
    rows = [(1, None, "<p>a"), (2, "u", None), (2, "u", None), (None, "http://h/", ""), (3, "http://h/", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((str(r.page_id), r.url, len(r.text)) for r in ht.extract(df).collect())
    assert got == [("1", None, 1), ("2", "u", 0), ("2", "u", 0), ("3", "http://h/", 249_999), ("None", "http://h/", 0)]
    assert ht.extract(df.limit(0)).count() == 0


def test_registered_query_takes_whole_articles(spark):
    from weekcast.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = QUERIES["op5_html_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id].html or "", re.DOTALL)
        want = " ".join(entities.unescape(re.sub(r"</?b>", "", inside[1]).replace("<", " <").replace(">", "> ") if inside else "").split())
        want = " ".join(re.sub(r"<[^>]*>", " ", want).split())
        assert re.sub(r"\s", "", r.text) == re.sub(r"\s", "", want) and r.n_chars == len(r.text)


def texts_of(spark, pages):
    df = spark.createDataFrame([(n, "http://h/", x) for n, x in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in ht.extract(df).collect()}


def test_copies_without_article_keep_their_text(spark):
    own = "<div class=text><h2>Same</h2><p>The very same text</p><p>on every page</p><ul><li>one</ul></div>"
    copies = [page(f"{own}<div class=advert>buy {n}</div><script>f({n})</script>" + "<nav>x</nav>" * n) for n in range(3)]
    assert set(texts_of(spark, copies).values()) == {"Same The very same text on every page one"}


def test_near_copies_that_dominate_a_host(spark):
    def body(top, text):
        return page(f"<div class=top>{top}</div><div class=text>{text}</div>")

    shared = "<h2>Same</h2>" + "".join(f"<p>the long shared paragraph number {'abcdefghij'[k]}</p>" for k in range(10))
    pages = [body(f"Site {'abcdefgh'[n]}", shared) for n in range(8)] + [body("Site a", "<p>an unlike page with quite other words</p>")]
    got = texts_of(spark, pages)
    assert all("Same the long shared paragraph number a" in got[n] and "number j" in got[n] for n in range(8))
    assert "an unlike page with quite other words" in got[8]


def test_repeated_inline_words_stay(spark):
    pages = [page(f"<article><p>own text {w} <b>Reuters</b> more <a>link</a> {w}</p></article>") for w in ("one", "two", "three")]
    assert texts_of(spark, pages) == {n: f"own text {w} Reuters more link {w}" for n, w in enumerate(("one", "two", "three"))}


def test_blocks_of_articles_stay_unless_most_articles_hold_them(spark):
    def article(h, p):
        return page(
            f"<article><h1>{h}</h1><p>{p}</p><div><p>nested words</p></div><ul><li>item</ul><blockquote>quoted</blockquote><pre>code</pre>"
            f"<table><tr><td>cell</table></article>"
        )

    copies = [article(f"Title {w}", "a paragraph that the copies share") for w in ("one", "two")]
    others = [page(f"<article><p>other page {w} with words of its own {w}</p><div class=foot>Read our terms</div></article>") for w in "abcdefg"]
    got = texts_of(spark, copies + others)
    assert got[0] == "Title one a paragraph that the copies share nested words item quoted code cell"
    assert got[1] == got[0].replace("one", "two")
    assert got[2] == "other page a with words of its own a"
    assert texts_of(spark, copies) == {0: got[0], 1: got[1]}


def test_articles_that_hold_little_are_not_the_page():
    text = "the main text of the page, which is longer than the cards"
    assert ht.main_text(page(f"<div class=content><p>{text}</p></div><article><h3>Other story</h3></article>"), set()) == f"{text} Other story"
    assert ht.main_text(page(f"<main></main><div class=content><p>{text}</p></div>"), set()) == text
    assert ht.main_text(page(f"<main><p>{text}</p></main><div>short</div>"), set()) == text
    low = {"//html/body/div.top"}  # what is low does not outweigh an article
    assert ht.main_text(page(f"<div class=top>{'menu ' * 30}</div><main><p>{text}</p></main>"), low) == text
    card = "<article><h3>Other story</h3></article>"  # nor does an article's teaser outweigh copies
    assert text in ht.main_text(page(f"<div class=text><p>{text}</p></div>{card}"), {"//html/body/div.text"})


def test_names_inside_articles_only_lower_the_importance(spark):
    def article(n):
        return page(
            f"<article><h1>Title {n}</h1><h2 id=comments>Heading {n}</h2><section id=related-work><p>Earlier work {n}</p></section><div id=advertising-revenue>Revenue {n}</div>"
            f"<p class=notice>Notice of {n}</p><div class=share-box>Share this page</div><div class='ad-slot'>Buy {n}</div><section id=comments>Nice {n}</section></article>"
        )

    words = ("one", "two", "three")
    got = texts_of(spark, [article(w) for w in words] + [page(f"<article><p>plain {k * 9}</p></article>") for k in "abcde"])
    assert [got[n] for n in range(3)] == [f"Title {w} Heading {w} Earlier work {w} Revenue {w} Notice of {w}" for w in words]
    assert "Share this page" in ht.main_text(article("one"), set())


def test_names_outside_articles_that_say_more_leave_it_to_the_tree(spark):
    """What the same words may name: an own text stays on every page, a repeated one goes."""
    words = ("one", "two", "three", "four")
    own = [page(f"<div id=related-work><p>Text number {w}</p></div><h2 class=post-header>Title {w}</h2><p class=share-price>Price {w}</p>") for w in words]
    assert texts_of(spark, own) == {n: f"Text number {w} Title {w} Price {w}" for n, w in enumerate(words)}
    same = [page(f"<div class=post><p>Own words {w}</p><p>and more {w * 3}</p></div><div class=related-tips>Read our tips</div>") for w in words]
    assert texts_of(spark, same) == {n: f"Own words {w} and more {w * 3}" for n, w in enumerate(words)}
    assert ht.main_text(page('<div class="header-image-wrapper"><p>The only text of the page</p></div>'), set()) == "The only text of the page"


def test_every_name_of_noise_beside_another_word_keeps_an_own_text(spark):
    names = sorted(ht.NOISE_NAMES - ht.QUALIFIERS)
    pages = [page("".join(f"<div class='{n}-quince'><p>text {n} {w}</p></div><p id='quince-{n}'>more {n} {w}</p>" for n in names)) for w in ("one", "two", "three")]
    got = texts_of(spark, pages)
    for k, w in enumerate(("one", "two", "three")):
        assert got[k] == " ".join(f"text {n} {w} more {n} {w}" for n in names)


def test_names_that_say_nothing_else_go_on_any_page():
    text = "the main text of the page"
    for name in [*sorted(ht.NOISE_NAMES), "site-header", "pageFooter", "left_sidebar", "main-menu", "cookie-notice-wrapper", "related-posts", "social-links"]:
        assert ht.main_text(page(f"<div class={name}>Not this</div><div class=text><p>{text}</p></div>"), set()) == text, name


def test_a_page_with_text_is_not_empty_for_the_name_of_a_box():
    assert ht.main_text(page("<div id=header><p>All there is</p><nav>Menu</nav></div>"), set()) == "All there is"
    assert ht.main_text(page("<div class=comments>Nice</div>"), set()) == ""
    assert ht.main_text(page("<nav>Menu</nav><script>x</script>"), set()) == ""


def test_hidden_parts_and_advert_slots_go():
    body = (
        "<article><p>shown</p><div hidden>a</div><p style='color:red; display : none'>b</p><div hidden=until-found>c</div><ins class='adsbygoogle'>d</ins>"
        "<p class='hidden-gem' title='hidden here'>a hidden gem</p><p data-x=hidden>kept</p></article><div class='adsbygoogle x'>e</div>"
    )
    assert ht.main_text(page(body), set()) == "shown a hidden gem kept"
