"""Content rewrite rules: a mini-language of names with quoted arguments, as in ``nl2br,replace("a"|"b")``.

Rules that only need text are Columns; those on elements run over the document tree in one pandas UDF.
"""

from __future__ import annotations

import base64
import re
from urllib.parse import parse_qs, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dom import Element, parse

_LINK = r"(?i)\bhttps?://[-A-Z0-9+&@#/%?=~_|!:,.;]*[-A-Z0-9+&@#/%=~_|]"

# Attributes in which pages keep the address of an image or frame that loads late, the best first.
IMAGE_SOURCES = (
    "data-src", "data-original", "data-orig", "data-url", "data-orig-file", "data-large-file", "data-medium-file", "data-original-mos", "data-2000src", "data-1000src",
    "data-800src", "data-655src", "data-500src", "data-380src",
)
FRAME_SOURCES = ("data-src", "data-original", "data-orig", "data-url", "data-lazy-src")
# Rules by domain, for entries whose feed has none of its own.
_TITLES = (
    "abstrusegoose.com amazingsuperpowers.com cowbirdsinlove.com drawingboardcomic.com exocomics.com explainxkcd.com happletea.com imogenquest.net lukesurl.com mercworks.net "
    "monkeyuser.com mrlovenstein.com nedroid.com optipess.com peebleslab.com sentfromthemoon.com thedoghousediaries.com treelobsters.com xkcd.com"
).split()
BY_DOMAIN = dict.fromkeys(_TITLES, "add_image_title") | {
    "bleepingcomputer.com": 'add_dynamic_image, remove(".ia_ad, .cz-related-article-wrapp, div[align]")',
    "blog.cloudflare.com": 'add_image_title,remove("figure.kg-image-card figure.kg-image + img")',
    "framatube.org": "nl2br,convert_text_link",
    "ilpost.it": 'remove(".art_tag, #audioPlayerArticle, .author-container, .caption, .ilpostShare, .lastRecents, #mc_embed_signup, .outbrain_inread, p:has(.leggi-anche), .youtube-overlay")',
    "medium.com": "fix_medium_images",
    "oglaf.com": 'replace("media.oglaf.com/story/tt(.+).gif"|"media.oglaf.com/comic/$1.jpg"),add_image_title',
    "phoronix.com": "remove(\"img[src^='/assets/categories/']\")",
    "quantamagazine.org": 'add_youtube_video_from_id, remove("h6:not(.byline,.post__title__kicker), #comments, .next-post__content, .footer__section, figure .outer--content, script")',
    "qwantz.com": "add_image_title,add_mailto_subject",
    "theverge.com": 'add_dynamic_image, remove("div.duet--recirculation--related-list, .hidden")',
    "vnexpress.net": 'add_dynamic_image, remove("h1.title-detail, .box-tinlienquanv2, .thumb-above-video, .parser_title, table[border=\\"0\\"], p.Normal:has(strong:only-child a), ul.link_content.ul-temp, ul.list-news, div.box-wg-guicauhoi")',
    "youtube.com": "add_youtube_video",
}


def rules(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """(name, arguments) of each rule in order."""
    out: list[tuple[str, tuple[str, ...]]] = []
    for name, quoted in re.findall(r'([A-Za-z_][A-Za-z0-9_]*)|"((?:[^"\\]|\\.)*)"', text or ""):
        if name:
            out.append((name, ()))
        elif out:
            out[-1] = (out[-1][0], (*out[-1][1], re.sub(r"\\(.)", r"\1", quoted)))
    return out


def _player(src: Column, content: Column) -> Column:
    return F.concat(F.lit('<iframe width="650" height="350" frameborder="0" src="'), src, F.lit('" allowfullscreen></iframe><br>'), content)


# Column rules: name to function of (columns, arguments) giving a Column.
def _nl2br(c, a):
    return F.replace(c["content"], F.lit("\n"), F.lit("<br>"))


def _video(url: Column) -> Column:
    """The id of a video page: the v of /watch, or the eleven characters after /shorts/; else ''."""
    ours = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")).rlike(r"^(.*\.)?youtube\.com$")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    watched = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.lit(""))
    return F.when(ours & (path == "/watch"), watched).when(ours, F.regexp_extract(path, r"^/shorts/(.{11})$", 1)).otherwise("")


def _youtube(c, a, host="www.youtube-nocookie.com"):
    video = _video(c["url"])
    return F.when(video != "", _player(F.concat(F.lit(f"https://{host}/embed/"), video), c["content"])).otherwise(c["content"])


def _youtube_from_id(c, a):
    ids = F.regexp_extract_all(c["content"], F.lit(r"youtube_id\"?\s*[:=]\s*\"([a-zA-Z0-9_-]{11})\""), F.lit(1))
    players = F.concat_ws("", F.transform(ids, lambda v: _player(F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), v), F.lit(""))))
    return F.concat(players, c["content"])


def _invidious(c, a):
    """Any host's /watch?v= page; its other parameters follow, sorted."""
    url = c["url"]
    video, host = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.lit("")), F.try_parse_url(url, F.lit("HOST"))
    rest = F.array_sort(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: ~p.startswith("v=")))
    src = F.concat(F.lit("https://"), host, F.lit("/embed/"), video, F.when(F.size(rest) > 0, F.concat(F.lit("?"), F.concat_ws("&", rest))).otherwise(""))
    found = (F.try_parse_url(url, F.lit("PATH")) == "/watch") & (video != "")
    return F.when(F.coalesce(found, F.lit(False)), _player(src, c["content"])).otherwise(c["content"])


def _pdf(c, a):
    return F.when(c["url"].endswith(".pdf"), F.concat(F.lit('<a href="'), c["url"], F.lit('">PDF</a><br>'), c["content"])).otherwise(c["content"])


def _replace(c, a):
    if len(a) < 2:
        return c["content"]
    try:
        re.compile(a[0])
    except re.error:
        return c["content"]
    return F.regexp_replace(c["content"], F.lit(a[0]), F.lit(a[1]))


COLUMNS = {
    "nl2br": _nl2br,
    "add_youtube_video": _youtube,
    "add_invidious_video": _invidious,
    "add_youtube_video_using_invidious_player": lambda c, a: _youtube(c, a, "yewtu.be"),
    "add_youtube_video_from_id": _youtube_from_id,
    "add_pdf_download_link": _pdf,
    "convert_text_link": lambda c, a: F.regexp_replace(c["content"], _LINK, '<a href="$0">$0</a>'),
    "convert_text_links": lambda c, a: F.regexp_replace(c["content"], _LINK, '<a href="$0">$0</a>'),
    "replace": _replace,
    "add_castopod_episode": lambda c, a: F.concat(F.lit('<iframe width="650" frameborder="0" src="'), c["url"], F.lit('/embed/light"></iframe><br>'), c["content"]),
}


def _image_title(root, a):
    for e in root.find("img[title][src]"):
        figure, image, caption = Element("figure"), Element("img", {"src": e.attrs["src"], "alt": e.attrs.get("alt", "")}), Element("figcaption")
        note = Element("p")
        note.add(e.attrs["title"])
        caption.add(note)
        figure.add(image)
        figure.add(caption)
        e.replace(figure)


def _query(url: str) -> dict[str, list[str]]:
    try:
        return parse_qs(urlsplit(url).query)
    except ValueError:
        return {}


def _mailto(root, a):
    for e in root.find("a[href^=mailto:]"):
        subject = _query(e.attrs["href"]).get("subject")
        if subject:
            e.add(f" [{subject[0]}]")


def _dynamic_image(root, a):
    changed = False
    for e in [x for x in root.elements() if x.tag in ("img", "div")]:
        for names, target in ((IMAGE_SOURCES, "src"), (("data-srcset",), "srcset")):
            late = next((e.attrs[n] for n in names if n in e.attrs), None)
            if late is None:
                continue
            changed = True
            if e.tag == "img":
                e.attrs[target] = late
            elif e.parent is not None and e in e.parent.children:
                e.replace(Element("img", {target: late, "alt": e.attrs.get("alt", "")}))
    if not changed:
        for e in root.find("noscript"):
            inner = e.find("img") or parse(e.text()).find("img")
            if len(inner) == 1:
                e.replace(inner[0])


def _dynamic_frame(root, a):
    for e in root.find("iframe"):
        late = next((e.attrs[n] for n in FRAME_SOURCES if n in e.attrs), None)
        if late is not None:
            e.attrs["src"] = late


def _inside(e: Element) -> list:
    """What a noscript element shows: its elements, or those of the markup that it holds as text."""
    return list(e.children) if any(isinstance(c, Element) for c in e.children) else parse(e.text()).children


def _medium(root, a):
    for e in root.find("figure.paragraph-image"):
        notes = e.find("noscript")
        if notes:
            e.replace(*(x for n in notes for x in _inside(n)))


def _noscript_figures(root, a):
    for e in root.find("figure"):
        notes = e.find("noscript")
        images = [i for i in e.find("img") if not any(n in notes for n in i.up())]
        if images and notes:
            shown = [x for n in notes for x in _inside(n)]
            for x in (*images, *notes):
                x.remove()
            for x in reversed(shown):
                e.children.insert(0, x)
                if isinstance(x, Element):
                    x.parent = e


def _remove(root, a):
    for s in a:
        for e in root.find(s):
            e.remove()


def _base64(root, a):
    """Every text below the elements chosen that is base64 as a whole is decoded."""
    chosen = root.find(a[0]) if a else [root]
    for e in dict.fromkeys(x for c in chosen for x in (c, *c.elements())):
        for i, c in enumerate(e.children):
            if isinstance(c, str):
                try:
                    e.children[i] = base64.b64decode(c.strip(), validate=True).decode("utf-8", "replace")
                except ValueError:
                    pass


def _hacker_news(app):
    def run(root, a):
        home = "https://news.ycombinator.com/"
        for e in root.find(f"a[href^={home}]"):
            url = e.attrs["href"]
            link = Element("a", {"href": url.replace(home, "hack://", 1) if app == "hack" else f"opener://x-callback-url/show-options?{urlencode({'url': url})}"})
            link.add("Open with HACK" if app == "hack" else "Open with Opener")
            e.parent.add(" ")
            e.parent.add(link)

    return run


def _tables(root, a):
    for tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th"):
        for e in root.find(tag):
            e.replace(*e.children)


def _ghost_cards(root, a):
    """A card becomes its link; cards that follow one another become a list of links."""
    cards, listing = root.find("figure.kg-card"), None
    for e in cards:
        first = lambda selector, e=e: next(iter(e.find(selector)), None)
        title, author, link = (x.text() if x is not None else "" for x in (first(".kg-bookmark-title"), first(".kg-bookmark-author"), None))
        link = first("a.kg-bookmark-container")
        href = link.attrs.get("href", "") if link is not None else ""
        if not href or not title:
            continue
        item = Element("a", {"href": href})
        item.add(title if not author or title.endswith(author) else f"{title} - {author}")
        beside = e.parent.children[e.parent.children.index(e) + 1 :]
        after = next((x for x in beside if isinstance(x, Element)), None) in cards
        if after and listing is None:
            listing = Element("ul")
            e.parent.children.insert(e.parent.children.index(e), listing)
            listing.parent = e.parent
        if listing is not None:
            entry = Element("li")
            entry.add(item)
            listing.add(entry)
            e.remove()
        else:
            e.replace(item)
        listing = listing if after else None


def _blur(root, a):
    for e in root.find("img[src]"):
        blur = _query(e.attrs["src"]).get("blur", [""])[0]
        if blur.isdigit() and int(blur) > 0:
            e.attrs["src"] = urlsplit(e.attrs["src"])._replace(query="").geturl()


ELEMENTS = {
    "add_image_title": _image_title, "add_mailto_subject": _mailto, "add_dynamic_image": _dynamic_image, "add_dynamic_iframe": _dynamic_frame, "fix_medium_images": _medium,
    "use_noscript_figure_images": _noscript_figures, "remove": _remove, "base64_decode": _base64, "add_hn_links_using_hack": _hacker_news("hack"),
    "add_hn_links_using_opener": _hacker_news("opener"), "remove_tables": _tables, "fix_ghost_cards": _ghost_cards, "remove_img_blur_params": _blur,
}


def rewrite_elements(html: str, chosen: list[tuple[str, tuple[str, ...]]]) -> str:
    root = parse(html)
    for name, arguments in chosen:
        ELEMENTS[name](root, arguments)
    return root.inner()


def apply(entries: DataFrame, text: str) -> DataFrame:
    """``entries`` after the rules, in order; the PDF rule always comes last. Unknown names are ignored."""
    df, held = entries, []

    def flush(df):
        if not held:
            return df
        chosen = list(held)
        held.clear()

        @F.pandas_udf("string")
        def run(html: pd.Series) -> pd.Series:
            return html.map(lambda h: rewrite_elements(h, chosen) if h is not None else None)

        return df.withColumn("content", run("content"))

    for name, a in [*rules(text), ("add_pdf_download_link", ())]:
        if name in ELEMENTS:
            held.append((name, a))
            continue
        df = flush(df)
        if name in COLUMNS:
            df = df.withColumn("content", COLUMNS[name]({"content": F.col("content"), "url": F.col("url")}, a))
        elif name == "replace_title" and len(a) >= 2:
            df = df.withColumn("title", F.regexp_replace("title", F.lit(a[0]), F.lit(a[1])))
        elif name == "remove_clickbait":
            df = df.withColumn("title", F.initcap(F.lower("title")))
        elif name == "add_enclosure_links" and "enclosures" in df.columns:
            esc = lambda u: F.replace(F.replace(F.replace(F.replace(F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;"))
            shown = F.filter(F.coalesce("enclosures", F.expr("array()")), lambda x: x["url"] != "")
            items = F.concat_ws("", F.transform(shown, lambda x: F.concat(F.lit('<li><a href="'), esc(x["url"]), F.lit('">'), esc(x["url"]), F.lit("</a></li>"))))
            df = df.withColumn("content", F.when(items != "", F.concat("content", F.lit("<hr/><ul>"), items, F.lit("</ul>"))).otherwise(F.col("content")))
    return flush(df)


def apply_by_domain(entries: DataFrame, own: str = "") -> DataFrame:
    """``entries`` after a feed's own rules, or without these after the rules of each entry's domain. Entries of a domain with rules are
    rewritten apart from the others, a branch for each set of rules."""
    if own:
        return apply(entries, own)
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))), r"^www\.", "")
    rest, out = ~host.isin(*sorted(BY_DOMAIN)), None
    for rule in dict.fromkeys(BY_DOMAIN.values()):
        part = apply(entries.filter(host.isin(*(d for d, r in BY_DOMAIN.items() if r == rule))), rule)
        out = part if out is None else out.unionByName(part)
    return apply(entries.filter(rest), "").unionByName(out)
