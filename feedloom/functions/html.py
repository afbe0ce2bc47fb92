"""HTML functions over whole documents: readability, sanitizing, links. Each has a pandas UDF of the same name with _udf."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from urllib.parse import urljoin, urlsplit

import pandas as pd

from feedloom.functions.dom import VOID, Element, parse
from feedloom.functions.udf import pandas_function
from feedloom.functions.urls import clean_url, host_of

# Parts of class names and ids, by what they say of an element.
STRONG = ("popupbody", "-ad", "g-plus")
MAYBE = ("and", "article", "body", "column", "main", "shadow", "content")
UNLIKELY = (
    "banner", "breadcrumbs", "combx", "comment", "community", "cover-wrap", "disqus", "extra", "foot", "header", "legends", "menu", "modal", "related",
    "remark", "replies", "rss", "shoutbox", "sidebar", "skyscraper", "social", "sponsor", "supplemental", "ad-break", "agegate", "pagination", "pager",
    "popup", "yom-remote",
)
POSITIVE = ("article", "blog", "body", "content", "entry", "h-entry", "hentry", "main", "page", "pagination", "post", "story", "text")
NEGATIVE = (
    "author", "banner", "byline", "com-", "combx", "comment", "contact", "dateline", "foot", "hid", "masthead", "media", "meta", "modal", "outbrain",
    "promo", "related", "scroll", "share", "shopping", "shoutbox", "sidebar", "skyscraper", "sponsor", "tags", "tool", "widget", "writtenby",
)
SCORED = frozenset("section h2 h3 h4 h5 h6 p td pre div".split())
BASE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "img": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
NOT_PARAGRAPH = frozenset("a blockquote div dl img ol p pre table ul".split())

# The tags that may stay in sanitized content, with the attributes that they may keep.
ALLOWED = {
    "a": "href title id", "abbr": "title", "acronym": "title", "aside": "", "audio": "src", "blockquote": "", "b": "", "br": "", "caption": "", "cite": "", "code": "",
    "dd": "id", "del": "", "dfn": "", "dl": "id", "dt": "id", "em": "", "figcaption": "", "figure": "", "h1": "id", "h2": "id", "h3": "id", "h4": "id", "h5": "id",
    "h6": "id", "hr": "", "i": "", "iframe": "width height frameborder src allowfullscreen", "img": "alt title src srcset sizes width height fetchpriority decoding",
    "ins": "", "kbd": "", "li": "id", "ol": "id", "p": "", "picture": "", "pre": "", "q": "cite", "rp": "", "rt": "", "rtc": "", "ruby": "", "s": "", "small": "", "samp": "",
    "source": "src type srcset sizes media", "strong": "", "sub": "", "sup": "id", "table": "", "td": "rowspan colspan", "tfoot": "", "th": "rowspan colspan", "thead": "",
    "time": "datetime", "tr": "", "u": "", "ul": "id", "var": "", "video": "poster height width src", "wbr": "", "math": "xmlns",
}
# The tags of formulas, which keep no attributes.
FORMULA = (
    "annotation annotation-xml maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable "
    "mtd mtext mtr munder munderover semantics"
).split()
ALLOWED |= dict.fromkeys(FORMULA, "")
# Tags that go with their content; schemes of links; hosts of players; parts of URLs that only count or share; images that may be inline.
DROPPED = frozenset("noscript script style".split())
SCHEMES = frozenset(
    "https http apt bitcoin callto dav davs ed2k facetime feed ftp geo git gopher irc irc6 ircs itms-apps itms magnet mailto news nntp rtmp sftp sip sips shortcuts skype "
    "spotify ssh steam svn svn+ssh tel webcal xmpp opener hack".split()
)
PLAYERS = frozenset(
    "bandcamp.com cdn.embedly.com dailymotion.com framatube.org open.spotify.com player.bilibili.com player.twitch.tv player.vimeo.com soundcloud.com vk.com w.soundcloud.com "
    "youtube-nocookie.com youtube.com".split()
)
BLOCKED = (
    "api.flattr.com", "www.facebook.com/sharer.php", "feeds.feedburner.com", "feedsportal.com", "linkedin.com/shareArticle", "pinterest.com/pin/create/button/",
    "stats.wordpress.com", "twitter.com/intent/tweet", "twitter.com/share", "x.com/intent/tweet", "x.com/share",
)
INLINE = tuple(f"data:image/{kind}" for kind in ("avif", "apng", "png", "svg", "jpg", "jpeg", "gif", "webp"))
NEEDED = {"a": ("href",), "iframe": ("src",), "source": ("src", "srcset"), "img": ("src", "srcset")}
URLS = frozenset(("href", "src", "poster", "cite"))
CHOICES = {"fetchpriority": ("high", "low", "auto"), "decoding": ("sync", "async", "auto")}
EMBED = "https://www.youtube-nocookie.com/embed/"


def _measures(root: Element) -> tuple[dict[int, int], dict[int, int], dict[int, float]]:
    """By element: bytes of its text, commas in it, and which share of the bytes stands in links; children before parents."""
    size: dict[int, int] = {}
    commas: dict[int, int] = {}
    linked: dict[int, int] = {}
    for e in [*list(root.elements())[::-1], root]:
        n = c = links = 0
        for x in e.children:
            if isinstance(x, Element):
                n, c = n + size[id(x)], c + commas[id(x)]
                links += linked[id(x)] + (size[id(x)] if x.tag == "a" else 0)
            else:
                n, c = n + len(x.encode()), c + x.count(",")
        size[id(e)], commas[id(e)], linked[id(e)] = n, c, links
    return size, commas, {k: linked[k] / n if n else 0.0 for k, n in size.items()}


def _unlikely(names: str) -> bool:
    names = names.lower()
    return any(s in names for s in STRONG) or not any(s in names for s in MAYBE) and any(s in names for s in UNLIKELY)


def _weight(names: str) -> int:
    names = names.lower()
    return -25 if any(s in names for s in NEGATIVE) else 25 if any(s in names for s in POSITIVE) else 0


def readable(html: str) -> str:
    """The article of a page: the element whose paragraphs score best, with siblings that score well too."""
    root = parse(html)
    for e in root.find("script,style"):
        e.remove()
    code = {id(x) for e in root.find("pre,code") for x in (e, *e.elements())} if root.find("pre,code") else set()
    for e in list(root.elements()):
        if e.tag in ("html", "body") or not ("class" in e.attrs or "id" in e.attrs) or id(e) in code:
            continue
        if _unlikely(e.attrs.get("class", "")) or _unlikely(e.attrs.get("id", "")):
            e.remove()
    for e in list(root.elements()):
        below = [c.tag for c in e.children if isinstance(c, Element)]
        if e.tag == "div" and (not below or below[0] not in NOT_PARAGRAPH):
            e.tag = "p"
    size, commas, density = _measures(root)
    score: dict[int, float] = {}
    nodes: dict[int, Element] = {}

    def add(e: Element, points: float) -> None:
        if id(e) not in nodes:
            nodes[id(e)] = e
            score[id(e)] = BASE.get(e.tag, 0) + _weight(e.attrs.get("class", "")) + _weight(e.attrs.get("id", ""))
        score[id(e)] += points

    for e in root.elements():
        n = size[id(e)]
        if e.tag in SCORED and n >= 25:
            points = 2 + commas[id(e)] + min(n // 100, 3)
            add(e.parent, points)
            if e.parent.parent is not None:
                add(e.parent.parent, points / 2)
    for k, e in nodes.items():
        score[k] *= 1 - density[id(e)]
    if nodes:
        top = max(nodes.values(), key=lambda e: score[id(e)])
    else:
        top = next(iter(root.find("body")), root)
    limit, parts = max(10, score.get(id(top), 0) / 5), []
    for e in [c for c in (top.parent.children if top.parent else [top]) if isinstance(c, Element)]:
        tag = "div"
        keep = e is top or score.get(id(e), -1e9) >= limit
        if not keep and e.tag == "p":
            tag, n, links, text = "p", size[id(e)], density[id(e)], e.text()
            keep = links < 0.25 if n >= 80 else links == 0 and (text.endswith(".") or ". " in text)
        if keep:
            parts.append(f"<{tag}>{e.inner()}</{tag}>")
    return f"<div>{''.join(parts)}</div>"


def candidates(srcset: str) -> list[tuple[str, str]]:
    """(URL, descriptors) of a srcset: a width with or without a height, or a density; others make the candidate void."""
    out = []
    for url, rest in re.findall(r"\s*,*\s*(\S*[^\s,])(?:\s+([^,]*?))?\s*(?:,|$)", srcset):
        if not rest or re.fullmatch(r"\d+w|\d+w\s+\d+h|\d+h\s+\d+w|\d+(\.\d+)?x", rest):
            out.append((url, rest or ""))
    return out


def joined(base: str, url: str) -> str | None:
    """``url`` seen from ``base``, or nothing if either is no URL."""
    try:
        full = urljoin(base, url.strip())
        urlsplit(full)
    except ValueError:
        return None
    return full


def _absolute(base: str, url: str) -> str | None:
    full = joined(base, url)
    return full if full and urlsplit(full).scheme.lower() in SCHEMES else None


def _player(url: str) -> str | None:
    """What an iframe may show: a player's URL, led to the host without cookies or asked not to track."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.netloc or "").removeprefix("www.")
    except ValueError:
        return None
    if parts.scheme not in ("http", "https", "") or host not in PLAYERS:
        return None
    query = f"?{parts.query}" if parts.query else ""
    if host == "youtube.com" and parts.path.startswith("/embed/"):
        return EMBED + parts.path.removeprefix("/embed/") + query
    if host == "player.vimeo.com" and parts.path.startswith("/video/"):
        return url + ("&dnt=1" if query else "?dnt=1")
    return url


def _kept(tag: str, attrs: dict[str, str], base: str) -> dict[str, str] | None:
    """The attributes that may stay, with those that are added; nothing if the element has to give way."""
    out: dict[str, str] = {}
    allowed, anchor = ALLOWED[tag].split(), False
    for k, v in attrs.items():
        if k not in allowed or tag == "img" and (k in CHOICES and v not in CHOICES[k] or k in ("width", "height") and not (v.isdigit() and int(v) > 0)):
            continue
        if tag == "math":
            v = "http://www.w3.org/1998/Math/MathML"
        elif k == "srcset":
            found = [(_absolute(base, u), d) for u, d in candidates(v)]
            v = ", ".join(f"{u} {d}".strip() for u, d in found if u and not any(b in u for b in BLOCKED))
            if not v:
                continue
        elif k in URLS and tag == "iframe":
            v = _player(v)
            if v is None:
                return None
        elif k in URLS and tag == "img" and k == "src" and v.startswith(INLINE):
            pass
        elif k in URLS and tag == "a" and v.startswith("#"):
            anchor = True
        elif k in URLS:
            if any(b in v for b in BLOCKED):
                return None
            v = _absolute(base, v)
            if v is None:
                continue
            v = clean_url(v, urlsplit(base).hostname or "") if "?" in v else v
        out[k] = v
    if tag in NEEDED and not any(k in out for k in NEEDED[tag]):
        return None
    if tag == "a" and not anchor:
        out |= {"rel": "noopener noreferrer", "referrerpolicy": "no-referrer", "target": "_blank"}
    elif tag in ("audio", "video"):
        out["controls"] = ""
    elif tag == "iframe":
        out |= {"sandbox": "allow-scripts allow-same-origin allow-popups allow-popups-to-escape-sandbox", "loading": "lazy"}
        if (urlsplit(attrs["src"]).netloc or "").removeprefix("www.") in ("youtube.com", "youtube-nocookie.com"):
            out["referrerpolicy"] = "strict-origin-when-cross-origin"
    elif tag == "img":
        out["loading"] = "lazy"
    return out


def _escape(text: str) -> str:
    return escape(text, quote=False).replace('"', "&#34;").replace("'", "&#39;")


def sanitize(html: str, base: str = "") -> str:
    """Only allowed tags and attributes, absolute URLs, no trackers; other tags give way to their content.

    Scripts, styles, hidden elements, images of one pixel and iframes of other hosts go with their content. A URL that can't be
    read, or a base that can't, takes its attribute away. Nesting of any depth is walked with a stack.
    """
    base = base if joined(base, "") is not None else ""
    parts: list[str] = []
    open_: list[tuple[str, Iterator]] = [("", iter(parse(html).children))]
    while open_:
        end, rest = open_[-1]
        for c in rest:
            if not isinstance(c, Element):
                parts.append(_escape(c))
                continue
            if c.tag in DROPPED or "hidden" in c.attrs or c.tag == "img" and {c.attrs.get("width"), c.attrs.get("height")} <= {"0", "1"}:
                continue
            attrs = _kept(c.tag, c.attrs, base) if c.tag in ALLOWED else None
            if attrs is None:
                if c.tag != "iframe":
                    open_.append(("", iter(c.children)))
                    break
                continue
            parts.append(f"<{c.tag}{''.join(f' {k}' if k == 'controls' else f' {k}="{_escape(v)}"' for k, v in attrs.items())}>")
            if c.tag in VOID:
                continue
            if c.tag == "iframe":
                parts.append("</iframe>")
                continue
            open_.append((f"</{c.tag}>", iter(c.children)))
            break
        else:
            parts.append(end)
            open_.pop()
    return "".join(parts)


FEED_TYPES = {"application/rss+xml": "rss", "application/atom+xml": "atom", "application/json": "json", "application/feed+json": "json"}


def feed_links(html: str, base: str) -> list[tuple[str, str, str]]:
    """(title, URL, kind) of the feeds that a page's head names."""
    out, seen = [], set()
    for e in parse(html).find("link[rel=alternate]"):
        kind, href = FEED_TYPES.get(e.attrs.get("type", "").lower()), e.attrs.get("href", "").strip()
        url = joined(base, href) if href else ""
        if kind and url and url not in seen and not (kind == "json" and "/wp-json/" in url):
            seen.add(url)
            out.append((e.attrs.get("title", "") or url, url, kind))
    return out


def icon_links(html: str, base: str) -> list[str]:
    rels = ("icon", "shortcut icon", "icon shortcut", "apple-touch-icon", "apple-touch-icon-precomposed")
    links = [(e.attrs.get("rel", "").lower(), e.attrs.get("href", "").strip()) for e in parse(html).find("link")]
    found = [joined(base, href) for r in rels for rel, href in links if rel == r and href]
    return [u for u in dict.fromkeys(found) if u]


def select(html: str, selector: str) -> str:
    """The outer HTML of all that a selector matches."""
    return "".join(e.outer() for e in parse(html).find(selector))


#: What to take of the pages of some sites, by domain.
SITE_SELECTORS = {
    "arstechnica.com": "div.post-content",
    "bbc.co.uk": "div.vxp-column--single, div.story-body__inner, ul.gallery-images__list",
    "bleepingcomputer.com": ".articleBody",
    "blog.cloudflare.com": "div.post-content",
    "cbc.ca": ".story-content",
    "darkreading.com": "div.ArticleBase-Body",
    "developpez.com": "div[itemprop=articleBody]",
    "dilbert.com": "span.comic-title-name, img.img-comic",
    "explosm.net": "div#comic",
    "financialsamurai.com": "article",
    "francetvinfo.fr": ".text",
    "github.com": "article.entry-content",
    "heise.de": "header .article-content__lead, header .article-image, div.article-layout__content.article-content",
    "igen.fr": "section.corps",
    "ikiwiki.iki.fi": ".page.group",
    "ilpost.it": ".entry-content",
    "ing.dk": "section.body",
    "lapresse.ca": ".amorce, .entry",
    "lemonde.fr": "article",
    "lepoint.fr": ".art-text",
    "lesjoiesducode.fr": ".blog-post-content img",
    "lesnumeriques.com": ".text",
    "linux.com": "div.content, div[property]",
    "mac4ever.com": "div[itemprop=articleBody]",
    "monwindows.com": ".blog-post-body",
    "npr.org": "#storytext",
    "oneindia.com": ".io-article-body",
    "opensource.com": "div[property]",
    "openingsource.org": "article.suxing-popup-gallery",
    "osnews.com": "div.newscontent1",
    "phoronix.com": "div.content",
    "pitchfork.com": "#main-content",
    "pseudo-sciences.org": "#art_main",
    "quantamagazine.org": ".outer--content, figure, script",
    "raywenderlich.com": "article",
    "royalroad.com": ".author-note-portlet,.chapter-content",
    "slate.fr": ".field-items",
    "smbc-comics.com": "div#cc-comicbody, div#aftercomic",
    "swordscomic.com": "img#comic-image, div#info-frame.tab-content-area",
    "techcrunch.com": "div.entry-content",
    "theoatmeal.com": "div#comic",
    "theregister.com": "#top-col-story h2, #body",
    "theverge.com": "h2.inline:nth-child(2),h2.duet--article--dangerously-set-cms-markup,figure.w-full,div.duet--article--article-body-component",
    "turnoff.us": "article.post-content",
    "universfreebox.com": "#corps_corps",
    "version2.dk": "section.body",
    "vnexpress.net": ".detail-new p.description, article.fck_detail",
    "wdwnt.com": "div.entry-content",
    "webtoons.com": ".viewer_img,p.author_text",
    "wired.com": "main figure, article",
    "zeit.de": ".summary, .article-body",
    "zdnet.com": "div.storyBody",
}


def scrape(html: str, url: str, rule: str = "") -> str:
    """The content of a page: what the feed's own rule selects, else the rule of its domain, else what reads like an article."""
    rule = rule.strip() or SITE_SELECTORS.get(host_of(url).lower().removeprefix("www."), "")
    return select(html, rule) if rule else readable(html)


@pandas_function("string")
def scrape_udf(html: pd.Series, url: pd.Series, rule: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else scrape(h, u or "", r or "") for h, u, r in zip(html, url, rule, strict=True)], dtype=object)


def proxied(html: str, proxy: str, kinds: tuple[str, ...] = ("image",), policy: str = "http-only") -> str:
    """Media URLs led through a proxy: those over http, or all."""
    import base64

    root = parse(html)
    tags = {"image": (("img", "src"), ("source", "srcset"), ("img", "srcset"), ("video", "poster")), "audio": (("audio", "src"),), "video": (("video", "src"),)}
    swap = lambda u: proxy + base64.urlsafe_b64encode(u.encode()).decode() if u.startswith("http://" if policy == "http-only" else ("http://", "https://")) else u
    for tag, attr in (x for k in kinds for x in tags[k]):
        for e in root.find(f"{tag}[{attr}]"):
            v = e.attrs[attr]
            e.attrs[attr] = ", ".join(" ".join(x for x in (swap(u), d) if x) for u, d in candidates(v)) if attr == "srcset" else swap(v)
    return root.inner()


@pandas_function("string")
def readable_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda h: readable(h) if h is not None else None)


@pandas_function("string")
def sanitize_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([sanitize(h, b or "") if h is not None else None for h, b in zip(html, base, strict=True)])


@pandas_function("array<struct<title:string,url:string,kind:string>>")
def feed_links_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("title", "url", "kind"), x, strict=True)) for x in feed_links(h or "", b or "")] for h, b in zip(html, base, strict=True)])


@pandas_function("array<string>")
def icon_links_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([icon_links(h or "", b or "") for h, b in zip(html, base, strict=True)])
