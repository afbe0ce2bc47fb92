"""Feed documents: detection, RSS, Atom, RDF and JSON readers, OPML. Documents are rows with bytes or text, parsed in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import escape, unescape
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions.text import decode_bytes, plain
from feedloom.schemas import PARSED

ATOM, ATOM03, RDF, RSS1, DC, CONTENT, MEDIA, ITUNES, PLAY = (
    f"{{{n}}}" for n in (
        "http://www.w3.org/2005/Atom", "http://purl.org/atom/ns#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/rss/1.0/", "http://purl.org/dc/elements/1.1/",
        "http://purl.org/rss/1.0/modules/content/", "http://search.yahoo.com/mrss/", "http://www.itunes.com/dtds/podcast-1.0.dtd",
        "http://www.google.com/schemas/play-podcasts/1.0",
    )
)
_BAD = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def feed_format(content: Column) -> Column:
    """json, rss, atom03, atom10, rdf or unknown, by the first character or the first element."""
    head = F.regexp_replace(F.regexp_replace(F.ltrim(content), r"(?s)^\x{FEFF}", ""), r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    root = F.lower(F.regexp_extract(head, r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z]+)", 1))
    old = F.regexp_extract(head, r"<(?:[\w.-]+:)?feed\b[^>]*", 0).rlike("version\\s*=\\s*[\"']0\\.3")
    return F.when(F.substring(F.ltrim(content), 1, 1) == "{", "json").when(root == "rss", "rss").when((root == "feed") & old, "atom03").when(root == "feed", "atom10").when(root == "rdf", "rdf").otherwise("unknown")


def _t(e, *tags: str) -> str:
    for tag in tags:
        x = e.find(tag) if e is not None else None
        if x is not None and "".join(x.itertext()).strip():
            return "".join(x.itertext()).strip()
    return ""


def _hash(*parts: str) -> str:
    return hashlib.sha256(next((p for p in parts if p), "").encode()).hexdigest()


def _size(text: str | None) -> int:
    return int(text) if (text or "").isdigit() else 0


def _row(feed: dict, base: str, url: str, **x) -> dict:
    url = urljoin(base, url) if url else ""
    title = x.pop("title") or plain(x.get("content", ""))[:100] or url
    return feed | {"url": url, "title": title, "comments_url": x.pop("comments_url", ""), "tags": sorted(set(t for t in x.pop("tags", ()) if t)), "enclosures": x.pop("enclosures", [])} | x


def _names(e: ET.Element, tag: str) -> list[str]:
    return [unescape("".join(c.itertext()).strip()) for c in e.findall(tag)]


def podcast_categories(channel: ET.Element) -> list[tuple[str, str, int]]:
    """(name, name of the category above, depth from 1) of a podcast's categories, at any depth; those without a name only hold others."""
    out: list[tuple[str, str, int]] = []

    def walk(e: ET.Element, above: str, depth: int) -> None:
        for c in e.findall(ITUNES + "category"):
            name = (c.get("text") or "").strip()
            if name:
                out.append((name, above, depth))
            walk(c, name or above, depth + bool(name))

    walk(channel, "", 1)
    return out


def media_description(item: ET.Element) -> str:
    """The first media description, of the item before its groups'; plain text gets links and line breaks."""
    for e in (item, *item.findall(MEDIA + "group")):
        for d in e.findall(MEDIA + "description"):
            text = d.text or ""
            text = text if d.get("type") == "html" else re.sub(r"(\bhttps?://\S+)", r'<a href="\1">\1</a>', text).replace("\n", "<br>")
            if text:
                return text
    return ""


#: What a medium says of the type of a file.
_MEDIUM = {"image": "image/*", "video": "video/*", "audio": "audio/*"}


def attachments(item: ET.Element, own: list[tuple], site: str) -> list[dict]:
    """kind, group, url, mime_type, size of thumbnails, then ``own`` enclosures, then media contents, then peer links; of each kind the item's
    before those of its groups (numbered from 0; -1 is the item). An address counts once, where it comes first."""
    groups = [(-1, item), *enumerate(item.findall(MEDIA + "group"))]
    found = [("thumbnail", g, x.get("url", ""), "image/*", None) for g, e in groups for x in e.findall(MEDIA + "thumbnail")] + own
    found += [("content", g, x.get("url", ""), x.get("type") or _MEDIUM.get(x.get("medium", ""), ""), x.get("fileSize")) for g, e in groups for x in e.findall(MEDIA + "content")]
    found += [("peer", g, x.get("href", ""), x.get("type", ""), None) for g, e in groups for x in e.findall(MEDIA + "peerLink")]
    out: dict[str, dict] = {}
    for kind, group, url, mime, size in found:
        if url.strip():
            full = urljoin(site, url.strip())
            out.setdefault(full, {"kind": kind, "group": group, "url": full, "mime_type": mime or "application/octet-stream", "size": _size(size)})
    return list(out.values())


def rss(root: ET.Element, url: str) -> Iterator[dict]:
    channel = root.find("channel")
    channel = root if channel is None else channel
    site = next((x.text.strip() for x in channel.findall("link") if x.text and x.text.strip()), url)
    site = urljoin(url, site)
    feed = {"feed_title": unescape(_t(channel, "title")) or site, "feed_url": url, "site_url": site}
    seen: dict[str, int] = {}
    for item in channel.iter("item"):
        guid, ref = _t(item, "guid"), item.find("guid")
        link = _t(item, "link", ATOM + "link") or next((x.get("href", "") for x in item.findall(ATOM + "link") if x.get("rel", "alternate") == "alternate"), "")
        if not link and guid.startswith(("http://", "https://")) and (ref is None or ref.get("isPermaLink", "true") != "false"):
            link = guid
        content = _t(item, CONTENT + "encoded", "description", PLAY + "description", ITUNES + "summary", ITUNES + "subtitle") or media_description(item)
        key = guid or link or _t(item, "title") + content
        again = seen.get(key, 0)
        seen[key] = again + 1
        own = [("enclosure", -1, x.get("url", ""), x.get("type", ""), x.get("length")) for x in item.findall("enclosure")]
        yield _row(
            feed, site, link, title=unescape(_t(item, "title", MEDIA + "title")), hash=_hash(guid + (f"#{again}{link}{_t(item, 'title')}" if again else ""), link, _t(item, "title") + content), author=plain(_t(item, PLAY + "author", ITUNES + "author", DC + "creator", "author") or _t(channel, ITUNES + "author", PLAY + "author", f"{ITUNES}owner/{ITUNES}name", f"{ITUNES}owner/{ITUNES}email", "managingEditor", "webMaster")),
            content=content, published=_t(item, "pubDate", DC + "date"), tags=[t for t in (_names(item, "category") + [c.get("label", "").strip() for c in item.findall(MEDIA + "category")]) if t] or _names(channel, "category") + [name for name, *_ in podcast_categories(channel)] + [c.get("text", "").strip() for c in channel.findall(PLAY + "category")],
            comments_url=_t(item, "comments"), enclosures=[{"url": x["url"], "mime_type": x["mime_type"], "size": x["size"]} for x in attachments(item, own, site)],
        )


def _markup(e) -> str:
    if e is None:
        return ""
    kind = e.get("type", e.get("mode", "text"))
    if kind in ("xhtml", "xml", "application/xhtml+xml"):
        return (e.text or "") + "".join(re.sub(r"</?(?:\w+:)", lambda m: m[0].split(":")[0][: 2 if m[0].startswith("</") else 1], re.sub(r' xmlns:?\w*="[^"]*"', "", ET.tostring(c, encoding="unicode"))) for c in e)
    text = "".join(e.itertext()).strip()
    return escape(text, quote=False) if kind == "text" and "<" in text and e.get("mode") is None else text


def atom(root: ET.Element, url: str, ns: str) -> Iterator[dict]:
    rel = lambda e, *rels: next((x.get("href", "").strip() for r in rels for x in e.findall(ns + "link") if x.get("rel", "alternate") == r and x.get("href")), "")
    site = urljoin(url, rel(root, "alternate") or url)
    feed = {"feed_title": unescape(_t(root, ns + "title")) or site, "feed_url": urljoin(url, rel(root, "self") or url), "site_url": site}
    names = lambda e: ", ".join(sorted({_t(a, ns + "name", ns + "email") for a in e.findall(ns + "author")} - {""}))
    for item in root.findall(ns + "entry"):
        link = rel(item, "alternate")
        content = _markup(item.find(ns + "content")) or _markup(item.find(ns + "summary")) or media_description(item)
        own = [("enclosure", -1, x.get("href", ""), x.get("type", ""), x.get("length")) for x in item.findall(ns + "link") if x.get("rel") == "enclosure"]
        enclosures = [{"url": x["url"], "mime_type": x["mime_type"], "size": x["size"]} for x in attachments(item, own, site)]
        date = ("published", "updated") if ns == ATOM else ("issued", "modified", "created")
        yield _row(
            feed, site, link, title=plain(_t(item, ns + "title", f".//{MEDIA}title")), hash=_hash(_t(item, ns + "id"), link), author=names(item) or names(root), content=content, published=_t(item, *(ns + d for d in date)),
            tags=[c.get("label") or c.get("term", "") for c in (item.findall(ns + "category") or root.findall(ns + "category"))], comments_url=next((x.get("href", "") for x in item.findall(ns + "link") if x.get("rel") == "replies" and "html" in x.get("type", "html")), ""), enclosures=enclosures,
        )


def rdf(root: ET.Element, url: str) -> Iterator[dict]:
    channel = root.find(RSS1 + "channel")
    site = urljoin(url, _t(channel, RSS1 + "link") or url)
    feed = {"feed_title": unescape(_t(channel, RSS1 + "title")) or site, "feed_url": url, "site_url": site}
    for item in root.findall(RSS1 + "item"):
        link, content = _t(item, RSS1 + "link"), _t(item, CONTENT + "encoded", RSS1 + "description")
        yield _row(feed, site, link, title=unescape(_t(item, DC + "title", RSS1 + "title")), hash=_hash(link, _t(item, RSS1 + "title") + content), author=plain(_t(item, DC + "creator") or _t(channel, DC + "creator")), content=content, published=_t(item, DC + "date"), tags=[])


def json_feed(text: str, url: str) -> Iterator[dict]:
    doc = json.loads(text)
    site = urljoin(url, doc.get("home_page_url") or url)
    feed = {"feed_title": (doc.get("title") or "").strip() or site, "feed_url": urljoin(url, doc.get("feed_url") or url), "site_url": site}
    people = lambda x: sorted({(a.get("name") or "").strip() for a in [*(x.get("authors") or []), x.get("author") or {}]} - {""})
    for item in doc.get("items") or []:
        content = item.get("content_html") or escape(item.get("content_text") or item.get("summary") or "", quote=False)
        link = (item.get("url") or item.get("external_url") or "").strip()
        enclosures = [{"url": urljoin(site, a["url"]), "mime_type": a.get("mime_type") or "application/octet-stream", "size": int(a.get("size_in_bytes") or 0)} for a in item.get("attachments") or [] if a.get("url")]
        yield _row(feed, site, link, title=(item.get("title") or "").strip(), hash=_hash(str(item.get("id") or ""), link, content), author=", ".join(people(item) or people(doc)), content=content, published=item.get("date_published") or item.get("date_modified") or "", tags=[str(t).strip() for t in item.get("tags") or []], enclosures=enclosures)


def parse_feed(data: bytes | str, url: str = "") -> list[dict]:
    """The items of a feed document of any kind; ValueError if it is none or broken."""
    text = data if isinstance(data, str) else decode_bytes(data)
    text = text.lstrip("\ufeff \t\r\n")
    if text.startswith("{"):
        return list(json_feed(text, url))
    text = re.sub(r"<\?xml[^>]*\?>", "", _BAD.sub("", text), count=1).lstrip()
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"not a feed: {e}") from e
    name = root.tag.rpartition("}")[2].lower()
    if name == "rss":
        return list(rss(root, url))
    if name == "feed":
        return list(atom(root, url, ATOM03 if root.tag.startswith(ATOM03) or root.get("version") == "0.3" else ATOM if root.tag.startswith(ATOM) else ""))
    if name == "rdf":
        return list(rdf(root, url))
    raise ValueError(f"not a feed: {name}")


def read_feeds(documents: DataFrame) -> DataFrame:
    """Items of documents (url, content as string or binary); broken documents give none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in re.split(r",\s*(?![^<]*>)", PARSED)]
        for pdf in batches:
            out = []
            for url, content in zip(pdf["url"], pdf["content"], strict=True):
                try:
                    out += parse_feed(content, url or "")
                except (ValueError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=names)

    return documents.select("url", "content").mapInPandas(rows, PARSED.replace("\n", " "))


#: A podcast's episode with the nested parts of its document.
EPISODES = """url string, guid string, title string, duration string, episode int, season int, image string, explicit boolean,
categories array<struct<name:string,above:string,depth:int>>, media array<struct<kind:string,group:int,url:string,mime_type:string,size:long>>, description string"""


def episodes(data: bytes | str, base: str = "") -> list[dict]:
    """The items of an RSS document with what podcasts say of them; nothing of other documents."""
    text = data if isinstance(data, str) else decode_bytes(data)
    try:
        root = ET.fromstring(re.sub(r"<\?xml[^>]*\?>", "", _BAD.sub("", text.lstrip("\ufeff \t\r\n")), count=1).lstrip())
    except ET.ParseError:
        return []
    channel = root.find("channel")
    if channel is None:
        return []
    site, number = urljoin(base, _t(channel, "link") or base), lambda t: int(t) if t.isdigit() and int(t) < 1 << 31 else None
    above = [{"name": n, "above": a, "depth": d} for n, a, d in podcast_categories(channel)]
    image = lambda e: next((x.get("href", "").strip() for x in e.findall(ITUNES + "image")), "")
    out = []
    for item in channel.iter("item"):
        own = [("enclosure", -1, x.get("url", ""), x.get("type", ""), x.get("length")) for x in item.findall("enclosure")]
        out.append(
            {
                "url": urljoin(site, _t(item, "link")) if _t(item, "link") else "", "guid": _t(item, "guid"), "title": _t(item, ITUNES + "title", "title"), "duration": _t(item, ITUNES + "duration"),
                "episode": number(_t(item, ITUNES + "episode")), "season": number(_t(item, ITUNES + "season")), "image": urljoin(site, image(item) or image(channel)) if image(item) or image(channel) else "",
                "explicit": (_t(item, ITUNES + "explicit") or _t(channel, ITUNES + "explicit")).lower() in ("yes", "true", "explicit"), "categories": above, "media": attachments(item, own, site), "description": media_description(item),
            }
        )
    return out


def read_episodes(documents: DataFrame) -> DataFrame:
    """EPISODES of documents (url, content as string or binary)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        category, medium = (pa.list_(pa.struct(x)) for x in ([("name", pa.string()), ("above", pa.string()), ("depth", pa.int32())], [("kind", pa.string()), ("group", pa.int32()), ("url", pa.string()), ("mime_type", pa.string()), ("size", pa.int64())]))
        kinds = dict.fromkeys(("url", "guid", "title", "duration", "image", "description"), pa.string()) | {"episode": pa.int32(), "season": pa.int32(), "explicit": pa.bool_(), "categories": category, "media": medium}
        names = [x.strip().split()[0] for x in re.split(r",\s*(?![^<]*>)", EPISODES)]
        schema = pa.schema([(n, kinds[n]) for n in names])
        for batch in batches:
            found = [x for url, content in zip(batch.column("url").to_pylist(), batch.column("content").to_pylist(), strict=True) if content for x in episodes(content, url or "")]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return documents.select("url", "content").mapInArrow(rows, EPISODES.replace("\n", " "))


def collisions(items: DataFrame) -> DataFrame:
    """How often an item's guid came before it in its feed: items (feed_id, guid, pos) with occurrence from 0."""
    return items.withColumn("occurrence", F.row_number().over(Window.partitionBy("feed_id", "guid").orderBy("pos")) - 1)


def opml_subscriptions(text: str) -> list[dict]:
    """Subscriptions of an OPML document at any depth; the nearest named outline above is the category."""
    root = ET.fromstring(re.sub(r"<\?xml[^>]*\?>", "", _BAD.sub("", text), count=1).lstrip("\ufeff \r\n"))
    out = []

    def walk(e, category: str) -> None:
        for o in e.findall("outline"):
            url = (o.get("xmlUrl") or "").strip()
            name = (o.get("title") or o.get("text") or "").strip()
            if url:
                site = (o.get("htmlUrl") or "").strip()
                out.append({"title": name or site or url, "feed_url": url, "site_url": site or url, "category": category})
            walk(o, category if url else name or category)

    body = root.find("body")
    walk(root if body is None else body, "")
    return out


def read_opml(documents: DataFrame) -> DataFrame:
    """title, feed_url, site_url, category from documents (content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for c in pdf["content"] for x in opml_subscriptions(c)], columns=["title", "feed_url", "site_url", "category"])

    return documents.select("content").mapInPandas(rows, "title string, feed_url string, site_url string, category string")
