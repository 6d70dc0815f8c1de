"""Main text of web pages by a site style tree.

The DOMs of one host's pages are merged by element path (tag, id and classes from the root down).
Each merged node has the child sequences it appears with (presentation) and the texts below it
(content). With m pages that hold the node:

* node importance: entropy, to base m, of its child sequences over the pages;
* content importance: 1 minus the mean entropy, to base m, of its texts' spread over the pages
  (a text on all pages counts 0, one on a single page counts 1);
* composite: ``(1 - g**l) * node + g**l * content`` for ``l`` child sequences, ``g`` of 0.9.

Branches whose composite importance is below ``THRESHOLD`` are removed from every page of the host.
What HTML itself names (menus, headers, footers, asides, forms, scripts, styles, hidden elements, and outside articles
classes or ids made of such names and of words for places and boxes alone, as ``site-header``) has importance 0 from the start, also on hosts with one page;
a name that has other words too (``related-work``, ``post-header``) only halves the importance, and the tree decides. A page
that would have no text for names of boxes alone keeps it. A page whose article
or main elements hold more text than the rest that is not low gives their text only. Copies of a page must not count as template. Pages with the
same text outside those parts are one page of the tree. Where the branch that holds most of a page's
text is itself low (near copies make it so), nothing in or above it is removed. Headings and
paragraphs that are children of an article stay, other branches below it are removed only if they
lie on most distinct article pages of the host (``common``; half the importance and any two pages, where a class or id sounds like noise), and if the low branches hold more than half of the
articles' text, or three quarters of a page without articles, none of them is removed.

Character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space. An inline element is no branch; its text belongs to the block around it.

Defined cases: null or empty html gives an empty text; a null url has the empty host; pages of a host
with the same text count once in its tree; malformed and unclosed markup is read leniently to the end; texts
of any length are taken whole; every input row gives one row (repeated and null ids too).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, written
from .url_filters import host_and_path

THRESHOLD = 0.3
GAMMA = 0.9
#: A path is at most so many elements deep; what is deeper counts to its last element.
DEPTH = 40

#: Elements of HTML by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp rtc s samp small span strike strong sub sup "
    "time tt u var wbr nobr img script style noscript template svg".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = frozenset(
    "head script style noscript template iframe object svg canvas audio video nav footer aside form button select textarea dialog menu noframes noembed".split()
)
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments disqus replies respond "
    "share sharing social newsletter subscribe subscription signup login related recommended widget widgets toolbar pagination pager adsbygoogle".split()
)
#: Words that may stand beside such a name without saying what else the part is.
PLACES = frozenset(
    "site page main global top bottom left right upper lower side inner outer center sticky fixed floating mobile desktop primary secondary first second third "
    "area bar block body box button buttons col column container content dialog form group icons inline item items layer link links list panel pane placeholder "
    "region row section slot strip thread unit wrap wrapper posts articles stories js is the my web blog".split()
)
#: Of those names, the ones that say so on any page, whatever text it has besides.
ALWAYS_NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsored adsbygoogle cookie cookies consent gdpr comment comments disqus replies respond".split())
#: Inside articles only these names of these elements are noise from the start.
HARD_NAME = re.compile(
    r"(ad|ads|adsbygoogle|advert|adverts|advertisement|advertisements|comment|comments|disqus|replies)([-_]*(area|banner|block|body|box|container|form|inline|item|list|section|slot|thread|unit|wrap|wrapper|\d+))*",
    re.IGNORECASE,
)
CONTAINERS = frozenset("div section ul ol dl table figure details ins span center fieldset".split())
HEADING = re.compile("h[1-6]")
#: Importance of a branch of an article by such another name, as a share of its composite importance.
NAMED_SHARE = 0.5
QUALIFIERS = frozenset("has with no without".split())
CONTENT = frozenset(("article", "main"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre section summary table ul".split()
)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
_NOT_SHOWN = re.compile(r"""(?:^|\s)style\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)display\s*:\s*none""", re.IGNORECASE)
_QUOTED = re.compile("\"[^\"]*\"|'[^']*'")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BREAK = None
#: Elements that are a piece of running text, not the branch that holds it.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption br hr".split())


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}


def _hidden(attributes: str) -> bool:
    """Whether an element is not shown: the attribute ``hidden``, or a style without display."""
    low = attributes.lower()
    return "hidden" in low and bool(_HIDDEN.search(_QUOTED.sub('""', attributes))) or "none" in low and bool(_NOT_SHOWN.search(attributes))


def _says_noise(name: str) -> bool:
    """Whether a class or id begins or ends with the name of a part that is not the article, such as ``cookie-notice``."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return bool(parts) and not QUALIFIERS.intersection(parts) and (parts[0] in NOISE_NAMES or parts[-1] in NOISE_NAMES)


def _only_noise(name: str) -> bool:
    """Whether such a name says nothing else: its other words are for places and boxes, as in ``site-header``."""
    return _says_noise(name) and all(p.lower() in NOISE_NAMES or p.lower() in PLACES for p in _NAME_PARTS.findall(name))


def _always_noise(name: str) -> bool:
    return _only_noise(name) and not ALWAYS_NOISE.isdisjoint(p.lower() for p in _NAME_PARTS.findall(name))


class Element:
    #: ``noise``: importance 0 from the start; ``sure``: not for the name of a box alone.
    __slots__ = ("tag", "path", "children", "inline", "noise", "sure", "inside", "named", "prose")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        names = _names(attributes)
        marks = "".join(f".{c}" for c in sorted(names.get("class", "").split())) + (f"#{names['id']}" if names.get("id") else "")
        own = re.sub(r"\d+", "0", tag + marks).replace("/", "")
        self.tag = tag
        above = parent.path if parent else ""
        self.inline = bool(above) and tag in INLINE  # no branch of its own: part of the block around it
        self.path = f"{above}/{own}" if above.count("/") < DEPTH and not self.inline else above
        self.children = parent.children if self.inline else []
        content = tag in CONTENT or names.get("role") == "main"
        self.inside = bool(parent and parent.inside) or content
        within = bool(parent and parent.inside)
        self.named = self._named(names, content, within)
        self.sure = bool(parent and parent.sure) or self._is_noise(names, content, within) or tag not in ("html", "body") and _hidden(attributes)
        self.noise = self.sure or bool(parent and parent.noise) or self._is_box(names, content, within)
        if self.noise:
            self.inside = False
        self.prose = within and parent.tag in CONTENT and (tag == "p" or bool(HEADING.fullmatch(tag))) and not self.named
        if parent:
            parent.children.append(own)

    def _given(self, names: dict[str, str]) -> list[str]:
        """Classes and id; a heading's id is an anchor made of its words and says nothing."""
        return [*names.get("class", "").split(), "" if HEADING.fullmatch(self.tag) else names.get("id", "")]

    def _named(self, names: dict[str, str], content: bool, within: bool) -> bool:
        """Whether an element has a name of noise that lowers its importance only."""
        if content or self.tag in ("html", "body"):
            return False
        given = self._given(names)
        if within:
            return any(_says_noise(n) and not re.search("header", n, re.IGNORECASE) for n in given)
        return any(_says_noise(n) for n in given)

    def _is_noise(self, names: dict[str, str], content: bool, within: bool) -> bool:
        if self.tag in ("html", "body"):
            return False
        if content:
            return any(re.fullmatch(r"(comment|reply|replies|comments)([-_]?(body|item|list|\d+))*", n, re.IGNORECASE) for n in self._given(names))
        if self.tag in NO_TEXT or names.get("role") in NO_TEXT_ROLES or self.tag == "header" and not within:
            return True
        if within:
            return self.tag in CONTAINERS and any(HARD_NAME.fullmatch(n) for n in self._given(names))
        return any(_always_noise(n) for n in self._given(names))

    def _is_box(self, names: dict[str, str], content: bool, within: bool) -> bool:
        """Whether an element outside articles is a part of the site by the whole of a name."""
        return not within and not content and self.tag not in ("html", "body") and any(_only_noise(n) for n in self._given(names))


def parse(html: str) -> tuple[list[Element], list[tuple[Element, str] | None]]:
    """The elements in page order, and the page's texts with their elements; None marks a block's border."""
    root = Element("", "", None)
    stack, elements, runs = [root], [], []
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        token = m.group()
        if token[0] != "<" or token == "<":
            runs.append((stack[-1], token))
        elif token.startswith("<![CDATA["):
            continue
        elif m[2] is None:
            continue
        elif m[1]:
            tag = m[2].lower()
            if tag not in INLINE or tag == "br":
                runs.append(BREAK)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
        else:
            tag = m[2].lower()
            if tag in CLOSES_P:
                _close(stack, ("p",), ("button", "td", "th", "caption", "table", "object", "article", "section", "div", "li", "aside", "nav", "header", "footer", "main", "form", "blockquote"))
            if tag in CLOSES:
                ends, limit = CLOSES[tag]
                _close(stack, ends.split(), limit)
            if tag not in INLINE:
                runs.append(BREAK)
            element = Element(tag, m[3], stack[-1])
            elements.append(element)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
                if tag in ("textarea", "title"):
                    runs.append((element, html[at : end.start() if end else n]))
                at = end.end() if end else n
            elif tag not in VOID and not m[3].rstrip().endswith("/"):
                stack.append(element)
            elif tag not in VOID and tag in CLOSES_P:  # a slash does not close such elements
                stack.append(element)
    return elements, runs


def _close(stack: list[Element], tags, limit) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in limit:
            return


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def features(html: str) -> set[tuple[str, str, int]]:
    """What one page adds to its host's tree: (path, kind, feature) with kind ``s`` for the child
    sequence of an element, ``t`` for a text and ``n`` for a name like noise in an article. Branches that are noise by name are left out."""
    return _features(*parse(html))


def _body(runs: list) -> int:
    """Identity of a page by its text without the parts that are noise by name."""
    return _hash(_joined([r for r in runs if r is BREAK or not r[0].noise], lambda e: True))


def _features(elements: list[Element], runs: list) -> set[tuple[str, str, int]]:
    shapes: dict[str, list[str]] = {}
    for e in elements:
        if not e.noise and not e.inline:
            shapes.setdefault(e.path, []).append(" ".join(e.children))
    found = {(path, "s", _hash("\n".join(rows))) for path, rows in shapes.items()}
    found.update((e.path, "n", 0) for e in elements if e.named and not e.noise and not e.inline)
    block: dict[str, list[str]] = {}
    for run in [*runs, BREAK]:
        if run is not BREAK:
            if not run[0].noise and run[0].path:
                block.setdefault(run[0].path, []).append(run[1])
            continue
        found.update((path, "t", _hash(text)) for path, pieces in block.items() if (text := " ".join("".join(pieces).split())))
        block = {}
    return found


def _under(path: str, branches: set[str]) -> bool:
    """Whether the path or one above it is among the branches."""
    while path:
        if path in branches:
            return True
        path = path.rpartition("/")[0]
    return False


def _joined(runs: list, keep) -> str:
    blocks, block = [], []
    for run in [*runs, BREAK]:
        if run is not BREAK:
            if keep(run[0]):
                block.append(run[1])
        elif block:
            blocks += entities.unescape("".join(block)).split()
            block = []
    return " ".join(blocks)


def main_text(html: str | None, branches: set[str], common: set[str] | None = None) -> str:
    """The page's text without the parts that are noise by name and without the given branches, of
    which articles lose only those that are ``common`` (None: all)."""
    if not html:
        return ""
    elements, runs = parse(html)
    if not any(r is not BREAK and not r[0].noise and r[1].strip() for r in runs):
        # nothing but boxes named like parts of a site: the text is in them
        return _joined([r for r in runs if r is BREAK or not r[0].sure], lambda e: True)
    runs = [r for r in runs if r is BREAK or not r[0].noise]
    texts = [r for r in runs if r is not BREAK]
    sizes, rest = _sizes(texts), _sizes(r for r in texts if not r[0].inside)
    articles = sum(sizes.values()) - sum(rest.values())
    high = sum(n for p, n in _sizes(r for r in texts if r[0].inside).items() if not _under(p, branches))
    # a low rest counts as template beside an article of a quarter of the page, else it may be a copied text
    content = 4 * articles >= sum(sizes.values()) and high > sum(n for p, n in rest.items() if not _under(p, branches))
    branches = _without_bulk(branches, sizes if not content else _sizes(r for r in texts if r[0].inside))
    content = content or articles > sum(n for p, n in rest.items() if not _under(p, branches))
    inside = [r for r in runs if r is BREAK or r[0].inside or not content]
    if content:
        within = {e.path for e in elements if e.inside and not e.noise}
        branches = branches - {e.path for e in elements if e.prose} - (within - common if common is not None else set())
    low = {e.path for e in elements if not e.noise and _under(e.path, branches)}
    sizes = _sizes(r for r in inside if r is not BREAK)
    most = 1 / 2 if content else 3 / 4
    if sum(n for p, n in sizes.items() if p in low) > most * sum(sizes.values()):
        low = set()
    return _joined(inside, lambda e: e.path not in low)


def _sizes(runs) -> dict[str, int]:
    """Characters of text by path."""
    sizes: dict[str, int] = {}
    for element, text in runs:
        sizes[element.path] = sizes.get(element.path, 0) + len(text.strip())
    return sizes


def _without_bulk(branches: set[str], sizes: dict[str, int]) -> set[str]:
    """The branches without those that would take the branch that holds most of the page's text, or
    parts of it, if they would."""
    if not branches:
        return branches
    below: dict[str, int] = {}
    for path, n in sizes.items():
        while path:
            below[path] = below.get(path, 0) + n
            path = path.rpartition("/")[0]
    bulk = max((p for p, n in below.items() if 2 * n > sum(sizes.values())), key=lambda p: p.count("/"), default="")
    if not _under(bulk, branches):
        return branches
    while re.split(r"[.#]", bulk.rpartition("/")[2])[0] in PIECES:
        bulk = bulk.rpartition("/")[0]
    return {b for b in branches if b != bulk and not bulk.startswith(b + "/") and not b.startswith(bulk.rstrip("/") + "/")}


def branches_of(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """The low-importance branches of every host's style tree: ``host``, ``branches`` (paths) and those of
    them that lie on more than half as many distinct pages as have articles, or are named like noise (``common``)."""
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where("length(html) > 0")
    rows = rows.select(host.alias("host"), F.xxhash64("html").alias("page"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for host, page, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
                    if (host, page) not in seen:
                        parsed = parse(html)
                        body = _body(parsed[1])
                        out += ((host, body, *x) for x in _features(*parsed))
                        if any(r is not BREAK and r[0].inside and r[1].strip() for r in parsed[1]):
                            out.append((host, body, "", "a", 0))
                        if len(seen) < 100_000:  # saves work only; copies are counted once below in any case
                            seen.add((host, page))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["host", "page", "path", "kind", "feature"])

    found = rows.mapInArrow(run, "host string, page bigint, path string, kind string, feature bigint")
    # a body counts once per path and text; of the child sequences of its copies one is taken
    found = found.groupBy("host", "page", "path", "kind", F.when(F.col("kind") == "t", F.col("feature")).alias("text")).agg(F.min("feature").alias("feature"))
    # written, so that the pages are parsed once for what hangs on the counts
    counted = written(found.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n")), "style-counts")
    shape, text, article, n = F.col("kind") == "s", F.col("kind") == "t", F.col("kind") == "a", F.col("n")
    nodes = counted.groupBy("host", "path").agg(
        F.sum(F.when(shape, n)).alias("m"), F.sum(F.when(shape, n * F.log(n))).alias("n_log_n"), F.count(F.when(shape, 1)).alias("shapes"),
        F.sum(F.when(text, F.log(n))).alias("log_n"), F.count(F.when(text, 1)).alias("texts"),
        F.sum(F.when(article, n)).alias("articles"), F.sum(F.when(F.col("kind") == "n", n)).alias("named"),
    )
    log_m = F.log("m")
    nodes = nodes.withColumns({
        "spread": F.when(F.col("m") > 1, F.coalesce("log_n", F.lit(0.0)) / log_m).otherwise(0.0),
        "node": F.when(F.col("m") > 1, (log_m - F.col("n_log_n") / F.col("m")) / log_m).otherwise(1.0),
    })
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, F.lit(1), k))))
    below = nodes.where("texts > 0").select("host", "spread", "texts", F.explode(above).alias("path"))
    below = below.groupBy("host", "path").agg(F.sum("spread").alias("spread_below"), F.sum("texts").alias("texts_below"))
    weight = F.pow(F.lit(GAMMA), "shapes")
    composite = (1 - weight) * F.col("node") + weight * (1 - F.col("spread_below") / F.col("texts_below"))
    composite *= F.when(F.col("named") > 0, NAMED_SHARE).otherwise(1.0)
    low = nodes.where("m > 1 or articles > 0").join(below, ["host", "path"], "left").where((F.col("articles") > 0) | (composite < threshold))
    branch = F.when(F.col("articles").isNull(), F.struct("path", "m", "named"))
    low = low.groupBy("host").agg(F.sort_array(F.collect_list(branch)).alias("low"), F.max("articles").alias("articles")).where("size(low) > 0")
    common = F.filter("low", lambda b: (2 * b["m"] > F.coalesce("articles", F.lit(0))) | b["named"].isNotNull())
    return low.select("host", F.col("low.path").alias("branches"), F.transform(common, lambda b: b["path"]).alias("common"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, url and the main text (``text``) of the whole page.

    The branch lists are written first, so that Spark knows their size and broadcasts them only if small.
    """
    low = written(branches_of(pages, url_col, html_col, threshold), "style-tree")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_and_path(F.col("url"))[0]).join(low, "host", "left").select("id", "url", "html", "branches", "common")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, set(b or ()), set(c or ())) for h, b, c in zip(*(part.column(n).to_pylist() for n in ("html", "branches", "common")))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
