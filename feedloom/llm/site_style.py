"""HTML extraction with a site style tree.

Pages of a host are merged into one tree of elements: an element is the path of tags, classes and ids that leads to it.
Over the pages that have an element, its presentation is the sequence of its children's tags, and its content are the
text blocks and link targets that stand in it (a block counts at the element nearest to it). Importance follows from entropy:
an element that looks alike and says the same on page after page is of low importance; one whose content differs from
page to page is of high importance.

    presentation = -sum p_i log_m p_i         over the presentations, m pages having the element (1 if m = 1)
    content      = 1 - mean over what it holds of log_m(pages that hold it)
    importance   = (1 - WEIGHT) * presentation + WEIGHT * content

Branches whose importance is under ``LEAST`` are removed, on hosts with at least ``PAGES`` pages that have the element; so is,
outside of articles, each block of text whose own content, ``1 - log_m(pages that hold it)``, is. An article
(``article``, ``main``, or an element with exactly such a class, id or role) isn't judged as an element, as what differs in it
would go with what repeats; root and body never go. What articles have in common is theirs, so a block of an article goes only if
at least ``SHARE`` of the pages that have its element hold it, on hosts of any size, and its headings always stay. What the tags or class names of a branch say comes first: menus,
footers, adverts, forms, comments and the like are of importance 0. A name says so only if all of its words do or are
neutral (``site-footer``, not ``has-sidebar`` or ``social-science``), and never of html, body, main or article.

Copies of a page are one page: what pages of a host have the same html (by 128 bits of hash) counts once, or they would pass
for content that repeats.

The tree is never gathered: tasks emit counts of (host, element, feature), these are summed by key, and only the
elements and blocks of low importance go back, as one row a host, to the host's pages.

Defined cases: a null or empty html gives an empty text. A page without a host is of the host ''. Repeated rows are
extracted each. Broken markup is closed as the end tags allow; nesting of any depth costs the same by element. An empty table
gives no rows, a very long page is read whole, and equal importance needs no order. Only page_id, url and html are read, so
other columns do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from feedloom.llm.common import Scratch, cut, id_bits

WEIGHT, LEAST, PAGES = 0.9, 0.2, 5
#: The part of the pages with an element of an article that must hold a block for it to be none of the article's own.
SHARE = 0.9
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: So many elements of low importance are broadcast; more are joined, every host in SALTS parts.
SENT, SALTS = 500_000, 32

# Tags, and words of class names, ids and roles, by what they stand for.
SILENT = frozenset("script style noscript template svg canvas iframe object head title select option textarea button".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner banners sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices newsletter subscribe subscription signup login search "
    "comment comments disqus respond reply replies share sharing social related recommended popup modal overlay toolbar pagination pager "
    "widget masthead topbar complementary contentinfo alert".split()
)
#: Words that name no more than a place or a part.
NEUTRAL_WORDS = frozenset(
    "site page global main primary secondary top bottom left right header list box container wrapper section area block bar inner outer "
    "item items entry post article body text author meta form thread count title links link icon icons group row col column panel".split()
)
MAIN_WORDS = frozenset(("article", "main"))
#: What no name makes noise.
KEPT_TAGS = frozenset(("html", "body", "main", "article"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLANK = " \t\n\x0b\x0c\r"
SPACE = re.compile(f"[{BLANK}]+")
#: Tags as pages mostly have them; all others go to the tolerant parser, which gives the same for these.
START, END = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9-]*="[^"&]*")*)>'), re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
ATTRIBUTE = re.compile(r' ([a-zA-Z][a-zA-Z0-9-]*)="([^"&]*)"')
#: What follows these may be no markup, as the tolerant parser knows.
RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())
#: So many different start tags, and sets of names, of so many characters each, a process remembers.
KNOWN, SHORT = 10_000, 300
#: An opening tag closes an open element of these tags, up to the nearest one that holds it.
HOLDS_P = BLOCKS - {"p"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Node:
    __slots__ = ("tag", "path", "silent", "noise", "main", "children", "parent", "links", "root")

    def __init__(self, tag: str, path: int, kind: str, parent: Node | None):
        self.tag, self.path, self.parent = tag, path, parent
        self.root = parent is None or tag == "body"
        self.silent = kind == "silent" or parent is not None and parent.silent
        self.noise = kind == "noise" or parent is not None and parent.noise
        self.main = kind == "main" or parent is not None and parent.main
        self.children: list[str] = []
        self.links: list[str] = []


def _is_noise(name: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NEUTRAL_WORDS for w in words)


@lru_cache(KNOWN)
def _kind(tag: str, names: str, hidden: bool) -> str:
    """silent, noise, main, header (noise outside of what is main) or '' of an element, by its tag and names."""
    if tag in SILENT:
        return "silent"
    names = names.lower().split()
    if tag not in KEPT_TAGS and (tag in NOISE_TAGS or any(map(_is_noise, names)) or hidden):
        return "noise"
    if tag == "header":
        return "header"
    return "main" if tag in MAIN_WORDS or tag != "body" and not MAIN_WORDS.isdisjoint(names) else ""


def _element(tag: str, attributes: dict) -> tuple[str, str, str, str]:
    """tag, label, kind and link target."""
    named = [(a, attributes[a]) for a in ("class", "id", "role") if attributes.get(a)]
    label = f"{tag} {' '.join(f'{a}={x}' for a, x in named)}" if named else tag
    judge = _kind if len(label) <= SHORT else _kind.__wrapped__
    kind = judge(tag, " ".join(x for _, x in named), attributes.get("aria-hidden") == "true" or "hidden" in attributes)
    return tag, label, kind, attributes.get("href") or ""


@lru_cache(KNOWN)
def _start(tag: str, attributes: str) -> tuple[str, str, str, str]:
    """The same of a tag that ``START`` matches."""
    return _element(tag.lower(), {name.lower(): x for name, x in ATTRIBUTE.findall(attributes)})


class Page(HTMLParser):
    """Blocks of text in page order, each with the chain of elements that it stands in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.root = Node("html", 0, "", None)
        self.top, self.blocks, self.parts, self.nodes, self.open = self.root, [], [], [self.root], Counter()
        self.feed(html)
        self.close()
        if self.rawdata:  # an unfinished tag or reference at the end
            if not self.rawdata.startswith("<"):
                self.handle_data(unescape(self.rawdata))
        self.flush()

    def updatepos(self, i, j):  # nobody asks for lines
        return j

    def parse_starttag(self, i):
        plain = START.match(self.rawdata, i)
        if plain is None or plain.group(1).lower() in RAW:
            return super().parse_starttag(i)
        read = _start if plain.end() - i <= SHORT else _start.__wrapped__
        self.begin(*read(*plain.groups()))
        return plain.end()

    def parse_endtag(self, i):
        plain = END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain.group(1).lower())
        return plain.end()

    def flush(self) -> None:
        if not self.parts:
            return
        text = "".join(self.parts).strip(BLANK)
        self.parts = []
        if text:
            self.blocks.append((self.top, SPACE.sub(" ", text) if "  " in text or any(x in text for x in BLANK[1:]) else text))

    def open_up(self, tag: str, label: str, kind: str, link: str) -> None:
        if tag in BLOCKS:
            self.flush()
        top = self.top
        top.children.append(tag)
        if kind == "header":
            kind = "" if top.main else "noise"
        node = Node(tag, xxh64_intdigest(f"{top.path}/{label}"), kind, top)
        if link:
            node.links.append(link)
        if tag not in VOID:
            self.top = node
            self.nodes.append(node)
            self.open[tag] += 1

    def handle_starttag(self, tag, attrs):
        self.begin(*_element(tag, dict(attrs)))

    def begin(self, tag: str, label: str, kind: str, link: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head":
                self.open_up(tag, label, kind, link)
            elif tag == "body":
                self.close_down("head")
                self.open_up(tag, label, kind, link)
            return
        if tag in BLOCKS:  # a paragraph ends where a block begins
            self.close_down("p", HOLDS_P)
        if tag in CLOSES:
            mine, holders = CLOSES[tag]
            for t in mine:
                self.close_down(t, holders)
        if tag == "br":
            self.parts.append(" ")
            return
        self.open_up(tag, label, kind, link)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def close_down(self, tag: str, holders: frozenset | set = frozenset()) -> None:
        if not self.open[tag]:
            return
        node = self.top
        while node is not None and node.parent is not None and node.tag != tag:
            if node.tag in holders:
                return
            node = node.parent
        if node is None or node.parent is None:
            return
        inner, block = self.top, False
        while inner is not node.parent:
            block |= inner.tag in BLOCKS
            self.open[inner.tag] -= 1
            inner = inner.parent
        if block:
            self.flush()
        self.top = node.parent

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self.flush()
        self.close_down(tag)

    def handle_data(self, data):
        if not self.top.silent:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(unescape(f"&{name};") if unescape(f"&{name};") != f"&{name};" else self._raw(f"&{name}"))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))

    def _raw(self, text: str) -> str:
        return unescape(text)


def _place(path: int, text: int) -> int:
    """The number of a block of text in an element, among those of low importance."""
    return xxh64_intdigest(f"{path} {text}")


def body_text(html: str | None, low: set[int]) -> str:
    """The main text of a page; ``low``: the host's elements and blocks of low importance."""
    if not html:
        return ""
    main, rest = [], []
    for node, text in Page(html).blocks:
        if node.silent or node.noise or not node.main and not node.root and node.path in low:
            continue
        if low and not node.root and _place(node.path, xxh64_intdigest(text)) in low:
            continue
        (main if node.main else rest).append(text)
    return "\n\n".join(main or rest)


def _heading(node: Node | None) -> bool:
    while node is not None and node.tag not in HEADINGS:
        node = node.parent
    return node is not None


def features(html: str) -> tuple[set[tuple[int, int]], ...]:
    """(element, feature) pairs of a page, of what its names don't remove already: presentations, link targets, blocks outside of articles,
    blocks of articles, headings of articles."""
    page = Page(html)
    shown, linked, held, inside, headings = set(), set(), set(), set(), set()
    for n in page.nodes:
        if not n.silent and not n.noise:
            shown.add((n.path, xxh64_intdigest(",".join(dict.fromkeys(n.children)))))
            linked.update((n.path, xxh64_intdigest(x)) for x in n.links)
    for node, text in page.blocks:
        if not node.silent and not node.noise:
            kind = held if not node.main else headings if _heading(node) else inside
            kind.add((node.path, xxh64_intdigest(text)))
    return shown, linked, held, inside, headings


def _places(path: str, text: str) -> Column:
    @F.arrow_udf("long")
    def place(path: pa.Array, text: pa.Array) -> pa.Array:
        both = zip(path.to_pylist(), text.to_pylist(), strict=True)
        return _signed([_place(p % 2**64, t % 2**64) for p, t in both])

    return place(F.col(path), F.col(text))


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, element, kind (0 presentation, 1 link target, 2 text, 3 of articles, 4 their headings), feature, pages; summed over part of a task."""
    total: dict[tuple, int] = {}

    def flush() -> pa.RecordBatch:
        host, element, kind, feature = zip(*total, strict=True) if total else ([],) * 4
        out = pa.record_batch([pa.array(host, pa.string()), _signed(element), pa.array(kind, pa.int32()), _signed(feature), pa.array(list(total.values()), pa.int64())], ["host", "element", "kind", "feature", "n"])
        total.clear()
        return out

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            html = html.as_py()
            if html:
                for kind, pairs in enumerate(features(html)):
                    for element, feature in pairs:
                        key = host, element, kind, feature
                        total[key] = total.get(key, 0) + 1
            if len(total) > 500_000:
                yield flush()
    yield flush()


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html to host, html, key: the first row of each host and html in the task."""
    seen = set()
    for batch in batches:
        rows, keys = [], []
        for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"), strict=True)):
            key = xxh128_digest(f"{host}\n".encode() + html.as_buffer().to_pybytes()) if html.is_valid else b""
            if key and key not in seen:
                seen.add(key)
                rows.append(i)
                keys.append(key)
        out = batch.select(["host", "html"]).take(pa.array(rows, pa.int64()))
        yield pa.record_batch([*out.columns, pa.array(keys, pa.binary())], ["host", "html", "key"])


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, html once each. A bit set of what occurs again lets most pages stay where they are; the others are compared
    in their task first, so that a page with many copies doesn't load one task, and then with those of all tasks."""
    pages = pages.filter("html IS NOT NULL")
    key, scratch = F.xxhash64("host", "html"), Scratch(pages.sparkSession)
    again = scratch.table(pages.groupBy(key.alias("page")).agg(F.count("*").alias("n")).filter("n > 1").select("page"))
    n, bits = id_bits(again, "page")
    scratch.drop(again)
    marked = pages.withColumn("h", F.pmod(F.xxhash64(key), F.lit(n)))

    def pick(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        words = bits.value.view(np.uint64)
        for batch in batches:
            h = batch.column("h").to_numpy()
            found = (words[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["host", "html"]).filter(pa.array(found == wanted))

    plain, schema = "host string, html string", "host string, html string, key binary"
    once = marked.mapInArrow(partial(pick, wanted=False), plain)
    more = marked.mapInArrow(lambda batches: _firsts(pick(batches, True)), schema).repartition("key").mapInArrow(_firsts, schema)
    return once.unionByName(more.select("host", "html"))


def low_importance(pages: DataFrame) -> DataFrame:
    """host, elements: the elements and blocks of low importance, for hosts that have any. pages: host, html."""
    counts = distinct_pages(pages).mapInArrow(_counts, "host string, element long, kind int, feature long, n long")
    counts = cut(counts.groupBy("host", "element", "kind", "feature").agg(F.sum("n").alias("n")))
    log = F.log(F.col("n").cast("double"))
    sums = counts.groupBy("host", "element").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * log)).alias("shown"),
        F.sum(F.when(F.col("kind") > 0, F.col("n"))).alias("held"),
        F.sum(F.when(F.col("kind") > 0, F.col("n") * log)).alias("common"),
    )
    sums = sums.filter(F.col("m") >= PAGES)
    base = F.log(F.col("m").cast("double"))
    presentation = (base - F.col("shown") / F.col("m")) / base
    content = 1 - F.coalesce(F.col("common") / F.col("held"), F.lit(0.0)) / base
    importance = (1 - WEIGHT) * presentation + WEIGHT * content
    # With PAGES pages or more, only text that so many hold can be of low importance, so few rows look for their element.
    again = counts.filter(F.col("kind").isin(2, 3) & (F.col("n") > PAGES ** (1 - LEAST))).join(sums.select("host", "element", "m"), ["host", "element"])
    common = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("m").cast("double")) < LEAST
    again = again.filter(F.when(F.col("kind") == 2, common).otherwise(F.col("n") >= SHARE * F.col("m")))
    low = sums.filter(importance < LEAST).select("host", "element").unionByName(again.select("host", _places("element", "feature").alias("element")))
    return low.groupBy("host").agg(F.collect_set("element").alias("elements"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    low = low_importance(pages.select("host", "html"))

    @F.arrow_udf("string")
    def text(html: pa.Array, elements: pa.Array) -> pa.Array:
        out, last, low = [], None, set()
        for h, e in zip(html, elements, strict=True):
            e = e.as_py() or []
            if e != last:
                last, low = e, {x % 2**64 for x in e}
            out.append(body_text(h.as_py(), low))
        return pa.array(out, pa.string())

    low = cut(low)
    if (low.agg(F.sum(F.size("elements"))).first()[0] or 0) <= SENT:
        both = pages.join(F.broadcast(low), "host", "left")
    else:
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(low, ["host", "salt"], "left")
    both = both.withColumn("text", text("html", "elements"))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
