"""Registered queries of text, URL, markup and feed functions over markup made of the entries, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import dates, html, media, rewrite, text, urls
from feedloom.functions.udf import pandas_function
from feedloom.operators import indexing
from feedloom.sources import corpus as C
from feedloom.sources import fetched, formats

NOW = datetime(2024, 1, 1, 12)
QUERIES: dict = {}
SQL: dict[str, str] = {}
EXTRA: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _made(template: str) -> Column:
    """``template`` with {id}, {feed} and {author} of each entry."""
    out = F.lit(template)
    for name, column in (("{id}", "entry_id"), ("{feed}", "feed_id"), ("{author}", "author")):
        out = F.replace(out, F.lit(name), F.col(column).cast("string"))
    return out


def _sql(template: str) -> str:
    """The same as SQL."""
    out = "'" + template.replace("'", "''") + "'"
    for name, column in (("{id}", "entry_id"), ("{feed}", "feed_id"), ("{author}", "author")):
        out = f"replace({out}, '{name}', {column}::VARCHAR)"
    return out


def _both(name: str, source: str, want: str, apply) -> None:
    """A query that applies a function of markup (and of the entry's URL) to markup of every entry, and the SQL of what must come out."""

    def run(spark, sf):
        e = C.entries(spark, sf).select("entry_id", _made(source).alias("html"), "url")
        return e.select("entry_id", apply(F.col("html"), F.col("url")).alias("out"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT entry_id, {_sql(want)} AS out FROM entries"


@pandas_function("string")
def _select(page, selector):
    return page.combine(selector, html.select)


@pandas_function("string")
def _proxied(page):
    return page.map(lambda h: html.proxied(h, "/proxy/"))


_both("extract_text_blocks", "<p>One {id}</p><p>two&nbsp;three &amp; more</p><script>no()</script><ul><li>a<li>{author}</ul><!-- no --><b>bo</b>ld", "One {id} two three & more a {author} bold", lambda h, u: text.extract_text_udf(h))
_both("strip_tags_raw", " <p title='a>b'>{id} &amp; x</p>\n<!-- <i> --> {author} < 3 ", "{id} &amp; x\n {author} < 3", lambda h, u: text.strip_tags(h))
_both("truncate_html", "<p>Entry   {id} of</p> {author} and a long tail of words", "Entry {id} of {author}", lambda h, u: F.regexp_extract(text.truncate_html(h, 40), r"^(Entry \d+ of author\d+)", 1))
_both("minify_html", "<p>a   {id}</p>\n\n<!-- c --><pre>x\n  y</pre>  <b>z</b> ", "<p>a {id}</p> <pre>x\n  y</pre> <b>z</b>", lambda h, u: text.minify(h))
_both("valid_xml", "a\x0b{id}\x01 ok", "a{id} ok", lambda h, u: text.valid_xml(h))
_both(
    "sanitize_markup",
    "<p onclick=x>{id}<script>no</script><blink>b</blink><a href='/x?utm_source=q&id={id}'>l</a><img src=i.png width=1 height=1><img src=i{id}.png></p><iframe src=https://evil.example/></iframe>",
    '<p>{id}b<a href="https://example.org/x?id={id}" rel="noopener noreferrer" referrerpolicy="no-referrer" target="_blank">l</a><img src="https://example.org/i{id}.png" loading="lazy"></p>',
    lambda h, u: html.sanitize_udf(h, F.lit("https://example.org/")),
)
_both("sanitize_srcset", '<img srcset="/a{id}.png 2x, b.png 100w 50h, c.png 3q">', '<img srcset="https://example.org/a{id}.png 2x, https://example.org/b.png 100w 50h" loading="lazy">', lambda h, u: html.sanitize_udf(h, F.lit("https://example.org/")))
_both("select_elements", '<div class="a"><p>x{id}</p></div><p>y</p><h6 class="by">z</h6>', "<p>x{id}</p>", lambda h, u: _select(h, F.lit("div.a > p, h6:not(.by)")))
_both("proxied_media", '<img src="https://e.org/{id}.png"><p>{author}</p>', '<img src="https://e.org/{id}.png"/><p>{author}</p>', lambda h, u: _proxied(h))
_both("feed_discovery", '<head><link rel="alternate" type="application/rss+xml" href="/f{id}.xml" title="F"><link rel="alternate" type="text/html" href="/x"></head>', "F https://example.org/f{id}.xml rss", lambda h, u: F.concat_ws(" ", F.transform(html.feed_links_udf(h, F.lit("https://example.org/")), lambda x: F.concat_ws(" ", x["title"], x["url"], x["kind"]))))
_both("icon_discovery", '<link rel="apple-touch-icon" href="/t{id}.png"><link rel="icon" href="i.png"><link rel="icon" href="http://[x">', "https://example.org/i.png https://example.org/t{id}.png", lambda h, u: F.concat_ws(" ", html.icon_links_udf(h, F.lit("https://example.org/"))))


def _rule(name: str, source: str, want: str, rule: str, url: str = "https://e.org/{id}") -> None:
    """A rewrite rule on the content of every entry."""

    def run(spark, sf):
        e = C.entries(spark, sf).select("entry_id", F.lit("An OLD title").alias("title"), _made(url).alias("url"), _made(source).alias("content"))
        return rewrite.apply(e, rule).select("entry_id", F.col("content").alias("out"))

    run.__name__ = f"rewrite_{name}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"SELECT entry_id, {_sql(want)} AS out FROM entries"


_FRAME = '<iframe width="650" height="350" frameborder="0" src="{}" allowfullscreen></iframe><br>'
_rule("add_image_title", '<img src="{id}.png" title="T {id}" alt="a">', '<figure><img src="{id}.png" alt="a"/><figcaption><p>T {id}</p></figcaption></figure>', "add_image_title")
_rule("add_mailto_subject", '<a href="mailto:x@e.org?subject=Re {id}">m</a>', '<a href="mailto:x@e.org?subject=Re {id}">m [Re {id}]</a>', "add_mailto_subject")
_rule("add_dynamic_image", '<div data-original-mos="{id}.jpg" alt="a"></div><img data-src="l.png" src="s.png">', '<img src="{id}.jpg" alt="a"/><img data-src="l.png" src="l.png"/>', "add_dynamic_image")
_rule("add_dynamic_iframe", '<iframe data-lazy-src="v{id}"></iframe>', '<iframe data-lazy-src="v{id}" src="v{id}"></iframe>', "add_dynamic_iframe")
_rule("add_youtube_video", "x{id}", _FRAME.format("https://www.youtube-nocookie.com/embed/v{id}") + "x{id}", "add_youtube_video", "https://www.youtube.com/watch?v=v{id}&t=1")
_rule("add_youtube_short", "x{id}", _FRAME.format("https://www.youtube-nocookie.com/embed/abcdefghijk") + "x{id}", "add_youtube_video", "https://youtube.com/shorts/abcdefghijk")
_rule("add_invidious_video", "x{id}", _FRAME.format("https://tube.example.org/embed/v{id}?a=1&t=2") + "x{id}", "add_invidious_video", "https://tube.example.org/watch?t=2&v=v{id}&a=1")
_rule("add_youtube_video_using_invidious_player", "x", _FRAME.format("https://yewtu.be/embed/v{id}") + "x", "add_youtube_video_using_invidious_player", "https://m.youtube.com/watch?v=v{id}")
_rule("add_youtube_video_from_id", 'x youtube_id: "abcdefghij1" {id}', _FRAME.format("https://www.youtube-nocookie.com/embed/abcdefghij1") + 'x youtube_id: "abcdefghij1" {id}', "add_youtube_video_from_id")
_rule("add_pdf_download_link", "x", '<a href="https://e.org/{id}.pdf">PDF</a><br>x', "", "https://e.org/{id}.pdf")
_rule("convert_text_link", "see https://e.org/a{id}?b=1, or not", 'see <a href="https://e.org/a{id}?b=1">https://e.org/a{id}?b=1</a>, or not', "convert_text_link")
_rule("fix_medium_images", '<figure class="paragraph-image"><noscript><img src="{id}"></noscript></figure>', '<img src="{id}"/>', "fix_medium_images")
_rule("use_noscript_figure_images", '<figure><img src="s"><noscript><img src="{id}"></noscript></figure>', '<figure><img src="{id}"/></figure>', "use_noscript_figure_images")
_rule("replace", "a{id}a", "b{id}b", 'replace("a"|"b"),replace("("|"x"),replace("b")')
_rule("remove", '<div class="x">no</div><p>{id}</p>', "<p>{id}</p>", 'remove(".x, .y")')
_rule("add_castopod_episode", "x", '<iframe width="650" frameborder="0" src="https://e.org/{id}/embed/light"></iframe><br>x', "add_castopod_episode")
_rule("base64_decode", "<p>SGVsbG8=</p><b>{id}!</b>", "<p>Hello</p><b>{id}!</b>", "base64_decode")
_rule("hacker_news_hack", '<p><a href="https://news.ycombinator.com/item?id={id}">c</a></p>', '<p><a href="https://news.ycombinator.com/item?id={id}">c</a> <a href="hack://item?id={id}">Open with HACK</a></p>', "add_hn_links_using_hack")
_rule("hacker_news_opener", '<p><a href="https://news.ycombinator.com/item?id={id}">c</a></p>', '<p><a href="https://news.ycombinator.com/item?id={id}">c</a> <a href="opener://x-callback-url/show-options?url=https%3A%2F%2Fnews.ycombinator.com%2Fitem%3Fid%3D{id}">Open with Opener</a></p>', "add_hn_links_using_opener")
_rule("remove_tables", "<table><tbody><tr><td>{id}</td><td>b</td></tr></tbody></table>", "{id}b", "remove_tables")
_rule("fix_ghost_cards", '<figure class="kg-card"><a class="kg-bookmark-container" href="u{id}"><div class="kg-bookmark-title">T</div><span class="kg-bookmark-author">A</span></a></figure>', '<a href="u{id}">T - A</a>', "fix_ghost_cards")
_rule("remove_img_blur_params", '<img src="https://e.org/{id}.png?w=9&blur=20">', '<img src="https://e.org/{id}.png"/>', "remove_img_blur_params")
_rule("by_name_unknown", "x{id}", "x{id}", "nonsense, add_image_titles")


@query("SELECT entry_id, 'A New Title' AS title FROM entries")
def rewrite_titles(spark, sf):
    e = C.entries(spark, sf).select("entry_id", F.lit("A OLD TITLE").alias("title"), "url", "content")
    return rewrite.apply(e, 'replace_title("OLD"|"NEW"),remove_clickbait').select("entry_id", "title")


@query("SELECT entry_id, content || '<hr/><ul>' || string_agg('<li><a href=\"' || url || '\">' || url || '</a></li>', '' ORDER BY enclosure_id) || '</ul>' AS content FROM (SELECT e.entry_id, 'c' || e.entry_id AS content, x.url, x.enclosure_id FROM entries e JOIN enclosures x USING (entry_id)) GROUP BY entry_id, content UNION ALL SELECT entry_id, 'c' || entry_id FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM enclosures)")
def rewrite_enclosure_links(spark, sf):
    from feedloom.operators import mutate

    e = C.entries(spark, sf).select("entry_id", "title", "url", F.concat(F.lit("c"), "entry_id").alias("content"))
    e = e.join(mutate.enclosures_by_entry(C.enclosures(spark, sf), e), "entry_id", "left")
    return rewrite.apply(e, "add_enclosure_links").select("entry_id", "content")


@query("SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN '<figure><img src=\"s\" alt=\"\"/><figcaption><p>T</p></figcaption></figure>' WHEN entry_id % 3 = 1 THEN 'a<br>b' ELSE '<img src=\"s\" title=\"T\">' END AS content FROM entries")
def rewrite_by_domain(spark, sf):
    n = F.col("entry_id") % 3
    e = C.entries(spark, sf).select("entry_id", "title", F.when(n == 0, "https://www.xkcd.com/1").when(n == 1, "https://framatube.org/1").otherwise("https://e.org/1").alias("url"), F.when(n == 1, "a\nb").otherwise('<img src="s" title="T">').alias("content"))
    return rewrite.apply_by_domain(e).select("entry_id", "content")


# URLs.
@query("SELECT entry_id, 'https://e.org/a/' || entry_id || '/x' AS url FROM entries")
def rewrite_url(spark, sf):
    rule = 'rewrite("/([0-9]+)/y$"|"/a/${1}/x")'
    return C.entries(spark, sf).select("entry_id", urls.rewrite_url(_made("https://e.org/{id}/y"), rule).alias("url"))


@query("SELECT entry_id, 'https://e.org/x?a=1&ref=other&z=' || entry_id AS url FROM entries")
def clean_own_references(spark, sf):
    """A reference is dropped if it names the feed's or the site's host."""
    e = C.entries(spark, sf)
    one = urls.clean_url_udf(_made("https://e.org/x?z={id}&MTM_x=1&ref=other&a=1"), F.lit("https://feed.org/f"), F.lit("https://site.org/"))
    two = urls.clean_url_udf(F.concat(one, F.lit("&ref=site.org")), F.lit("https://feed.org/f"), F.lit("https://site.org/"))
    return e.select("entry_id", F.when(two == _made("https://e.org/x?a=1&z={id}"), one).alias("url"))


@query("SELECT entry_id, 'https://e.org/' || feed_id || '/p?q' AS resolved, TRUE AS absolute, entry_id % 2 = 0 AS allowed FROM entries")
def url_helpers(spark, sf):
    e = C.entries(spark, sf)
    full = urls.resolve_udf(_made("https://e.org/{feed}/x"), F.lit(" p?q "))
    link = F.when(F.col("entry_id") % 2 == 0, "mailto:a@e.org").otherwise("javascript:x")
    return e.select("entry_id", full.alias("resolved"), urls.is_absolute(full).alias("absolute"), urls.scheme_allowed(link).alias("allowed"))


# Text, durations, dates.
@query("SELECT entry_id, length(trim(content)) > 0 AS has, FALSE AS empty FROM entries")
def contains_text(spark, sf):
    return C.entries(spark, sf).select("entry_id", text.has_text(F.concat(F.lit("<p>"), F.regexp_replace("content", "[<>&]", "x"), F.lit("</p>"))).alias("has"), text.has_text(F.lit("<p> <br>\n</p>")).alias("empty"))


@query("SELECT entry_id, left(title, 3) || repeat('é', 4) AS cut FROM (SELECT entry_id, 'abc' AS title FROM entries)")
def truncate_bytes(spark, sf):
    return C.entries(spark, sf).select("entry_id", text.truncate_bytes(F.lit("abcéééééé"), 12).alias("cut"))


@query("SELECT entry_id, entry_id % 50 * 60 + entry_id % 60 AS podcast, CASE WHEN entry_id % 50 + entry_id % 60 = 0 THEN 0 ELSE entry_id % 50 * 60 + entry_id % 60 END AS iso, NULL::BIGINT AS bad FROM entries")
def durations(spark, sf):
    e = C.entries(spark, sf)
    h, m = F.col("entry_id") % 50, F.col("entry_id") % 60
    clock = F.format_string("%d:%02d:59", h, m)
    return e.select("entry_id", text.podcast_minutes(clock).alias("podcast"), text.iso_minutes(F.format_string("PT%dH%dM59S", h, m)).alias("iso"), text.iso_minutes(F.lit("P1D")).alias("bad"))


@query("SELECT entry_id, published_at AS rfc, published_at AS iso, published_at AS unix, date_trunc('day', published_at) AS day, published_at + INTERVAL 5 HOURS AS zoned, published_at AS unnamed, TIMESTAMP '2024-01-05' AS french FROM entries")
def feed_dates(spark, sf):
    p, d = F.col("published_at"), dates.parse_date_udf
    return C.entries(spark, sf).select(
        "entry_id", d(F.date_format(p, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("rfc"), d(F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), d(F.unix_timestamp(p).cast("string")).alias("unix"),
        d(F.date_format(p, "dd MMM yyyy")).alias("day"), d(F.date_format(p, "EEE, dd MMM yyyy HH:mm:ss 'EST'")).alias("zoned"), d(F.date_format(p, "dd MMM yyyy HH:mm:ss 'EST'")).alias("unnamed"), d(F.lit("Vendredi, 5 janvier 2024")).alias("french"),
    )


@query("SELECT entry_id, left(upper(left(author, 1)) || regexp_replace(substr(author, 2), '[0-9]+', 'N', 'g'), 120) AS short, repeat('é', 60) || '...' AS long FROM entries")
def normalized_causes(spark, sf):
    first = F.concat(F.upper(F.substring("author", 1, 1)), F.expr("substring(author, 2)"))
    return C.entries(spark, sf).select("entry_id", indexing.failure_cause(first).alias("short"), indexing.failure_cause(F.lit("é" * 70)).alias("long"))


@query("SELECT entry_id, md5(title) AS md5, sha256(title) AS sha256 FROM entries")
def content_digests(spark, sf):
    return C.entries(spark, sf).select("entry_id", F.md5("title").alias("md5"), F.sha2("title", 256).alias("sha256"))


@query("SELECT n * 13 / 33.9 AS seconds, n AS entries FROM (SELECT count(*) AS n FROM entries)")
def reindex_eta(spark, sf):
    return indexing.reindex_time(C.entries(spark, sf))


# Enclosures and icons.
@query("""SELECT enclosure_id, lower(mime_type) LIKE 'audio/%' AS audio, lower(mime_type) LIKE 'video/%' AS video, lower(mime_type) LIKE 'image/%' OR lower(url) LIKE '%.png' AS image, CASE WHEN mime_type = 'video/m4v' THEN 'video/x-m4v' ELSE mime_type END AS html5 FROM enclosures""")
def enclosure_kinds(spark, sf):
    m = F.col("mime_type")
    return C.enclosures(spark, sf).select("enclosure_id", media.is_audio(m).alias("audio"), media.is_video(m).alias("video"), media.is_image(m, F.col("url")).alias("image"), media.html5_type(m).alias("html5"))


@query("SELECT entry_id, min(CASE WHEN mime_type LIKE 'audio/%' OR mime_type LIKE 'video/%' THEN enclosure_id END) AS playable, bool_or(mime_type LIKE 'audio/%' OR mime_type LIKE 'video/%') AS media FROM enclosures GROUP BY 1")
def playable_enclosures(spark, sf):
    from feedloom.operators import mutate

    x = mutate.enclosures_by_entry(C.enclosures(spark, sf), C.entries(spark, sf))
    return x.select("entry_id", media.playable(F.col("enclosures"))["enclosure_id"].alias("playable"), media.has_media(F.col("enclosures")).alias("media"))


@query("SELECT icon_id, CASE WHEN mime_type = 'text/html' THEN 'image/x-icon' ELSE lower(mime_type) END AS mime_type, CASE WHEN mime_type = 'text/html' THEN 'image/x-icon' ELSE lower(mime_type) END || ';base64,' || to_base64(content::BLOB) AS data FROM icons")
def icon_data(spark, sf):
    kind = media.icon_type(F.col("mime_type"))
    return C.icons(spark, sf).select("icon_id", kind.alias("mime_type"), media.data_url(kind, F.col("content")).alias("data"))


# Feed documents made of the entries, read back.
_ITEM = ["url", "title", "hash", "author", "published"]


def _read(spark, sf, template: str):
    e = C.entries(spark, sf).select("url", _made(template).alias("content"))
    return formats.read_feeds(e).select(*_ITEM, F.concat_ws(" ", "tags").alias("tags"), F.concat_ws(" ", F.transform("enclosures", lambda x: F.concat_ws(" ", x["url"], x["mime_type"], x["size"].cast("string")))).alias("enclosures"))


def _item(published: str, tags: str = "a b", enclosures: str = "https://e.org/m.mp3 audio/mpeg 7", key: str = "k{id}") -> str:
    return f"SELECT {_sql('https://e.org/{id}')} AS url, {_sql('Entry {id}')} AS title, sha256({_sql(key)}) AS hash, author, '{published}' AS published, '{tags}' AS tags, '{enclosures}' AS enclosures FROM entries"


@query(_item("Mon, 01 Jan 2024 00:00:00 GMT"))
def read_rss(spark, sf):
    return _read(spark, sf, "<?xml version='1.0'?><rss version='2.0'><channel><title>F</title><link>https://e.org/</link><item><title>Entry {id}</title><link>/{id}</link><guid>k{id}</guid><author>{author}</author><category>b</category><category>a</category><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><enclosure url='/m.mp3' type='audio/mpeg' length='7'/></item></channel></rss>")


@query(_item("2024-01-01T00:00:00Z"))
def read_atom(spark, sf):
    return _read(spark, sf, "<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><link href='https://e.org/'/><entry><id>k{id}</id><title>Entry {id}</title><link href='/{id}'/><link rel='enclosure' href='/m.mp3' type='audio/mpeg' length='7'/><author><name>{author}</name></author><category term='b'/><category term='a'/><published>2024-01-01T00:00:00Z</published></entry></feed>")


@query(_item("2004-01-01", tags="", enclosures=""))
def read_old_atom(spark, sf):
    return _read(spark, sf, "<feed version='0.3' xmlns='http://purl.org/atom/ns#'><title>F</title><link rel='alternate' href='https://e.org/'/><entry><id>k{id}</id><title>Entry {id}</title><link rel='alternate' href='https://e.org/{id}'/><author><name>{author}</name></author><issued>2004-01-01</issued></entry></feed>")


@query(_item("2024-01-01", tags="", enclosures="", key="https://e.org/{id}"))
def read_rdf(spark, sf):
    return _read(spark, sf, "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>F</title><link>https://e.org/</link></channel><item><title>Entry {id}</title><link>https://e.org/{id}</link><dc:creator>{author}</dc:creator><dc:date>2024-01-01</dc:date></item></rdf:RDF>")


@query(_item("2024-01-01T00:00:00Z"))
def read_json_feed(spark, sf):
    return _read(spark, sf, '{"version": "https://jsonfeed.org/version/1.1", "title": "F", "home_page_url": "https://e.org/", "items": [{"id": "k{id}", "url": "/{id}", "title": "Entry {id}", "authors": [{"name": "{author}"}], "tags": ["b", "a"], "date_published": "2024-01-01T00:00:00Z", "attachments": [{"url": "/m.mp3", "mime_type": "audio/mpeg", "size_in_bytes": 7}]}]}')


@query("SELECT entry_id, ['json', 'rss', 'atom10', 'atom03', 'rdf', 'unknown'][entry_id % 6 + 1] AS format FROM entries")
def feed_formats(spark, sf):
    docs = ("{}", "<?xml version='1.0'?><!-- c --><rss>", "<feed xmlns='a'>", "<feed version='0.3'>", "<rdf:RDF>", "<html>")
    doc = F.element_at(F.array(*map(F.lit, docs)), (F.col("entry_id") % 6 + 1).cast("int"))
    return C.entries(spark, sf).select("entry_id", formats.feed_format(doc).alias("format"))


@query("SELECT f.title, f.feed_url, 'https://' || f.host || '/' AS site_url, c.title AS category FROM feeds f JOIN categories c USING (category_id) WHERE f.user_id = 1")
def opml_round_trip(spark, sf):
    """What is exported comes in again."""
    from feedloom.operators import mutate

    outlines = mutate.opml(C.feeds(spark, sf).filter("user_id = 1"), C.categories(spark, sf))
    docs = outlines.select(F.concat(F.lit("<?xml version='1.0'?><opml version='2.0'><body>"), "outline", F.lit("</body></opml>")).alias("content"))
    return formats.read_opml(docs)


@query("SELECT entry_id, entry_id % 4 <> 0 AS modified, CASE entry_id % 3 WHEN 0 THEN 120 WHEN 1 THEN 3600 ELSE 0 END AS retry, entry_id % 1000 AS max_age, entry_id % 2 = 0 AS redirect FROM entries")
def fetched_pages(spark, sf):
    n = F.col("entry_id")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(NOW)) + 3600), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    retry = F.when(n % 3 == 0, "120").when(n % 3 == 1, at)
    headers = F.create_map(F.lit("etag"), F.concat(F.lit("e"), n % 4), F.lit("retry-after"), retry, F.lit("cache-control"), F.concat(F.lit("private, max-age="), n % 1000, F.lit(", x")))
    status = F.when(n % 2 == 0, 302).otherwise(200)
    return C.entries(spark, sf).select("entry_id", fetched.is_modified(status, headers, F.lit("e0"), F.lit("")).alias("modified"), fetched.retry_seconds(headers, NOW).alias("retry"), fetched.max_age_seconds(headers).alias("max_age"), fetched.is_redirect(status).alias("redirect"))


@query("SELECT page_id, minutes FROM pages_read")
def page_reading_time(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", text.reading_time(F.col("html")).alias("minutes"))


@query(r"SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN content WHEN 3 THEN content WHEN 1 THEN regexp_replace(content, '[^\x00-\x{FF}]', '?', 'g') ELSE '<?xml version=''1.0'' encoding=''windows-1252''?>' || regexp_replace(content, '[^\x00-\x{FF}]', '?', 'g') END AS text FROM entries")
def decoded_documents(spark, sf):
    """UTF-8 under a wrong name, Latin-1 by its content type, Windows-1252 by its prolog, UTF-16 by its mark."""
    plain = F.regexp_replace("content", r"[^\x{00}-\x{FF}]", "?")
    prolog = F.lit("<?xml version='1.0' encoding='windows-1252'?>")
    kind = F.col("entry_id") % 4
    data = F.when(kind == 0, F.encode("content", "UTF-8")).when(kind == 1, F.encode(plain, "ISO-8859-1")).when(kind == 2, F.encode(F.concat(prolog, plain), "ISO-8859-1")).otherwise(F.encode("content", "UTF-16"))
    declared = F.when(kind == 0, "text/xml; charset=latin1").when(kind == 1, 'application/rss+xml; charset="ISO-8859-1"').otherwise("")
    return C.entries(spark, sf).select("entry_id", text.decode_udf(data, declared).alias("text"))


@query("""SELECT entry_id, CASE entry_id % 3 WHEN 0 THEN '<article><p>A' || entry_id || '</p></article>' WHEN 1 THEN '<div id="storytext">S' || entry_id || '</div>' ELSE '<p class="mine">M</p>' END AS content FROM entries""")
def scraped_by_domain(spark, sf):
    """By the rule of the page's domain, with www or without; a rule of the feed's own comes first."""
    page = _made('<body><div class="top">T</div><article><p>A{id}</p></article><div id="storytext">S{id}</div><p class="mine">M</p></body>')
    kind = F.col("entry_id") % 3
    url = F.when(kind == 0, "https://www.lemonde.fr/a").when(kind == 1, "http://npr.org/b?c").otherwise("https://lepoint.fr/x")
    return C.entries(spark, sf).select("entry_id", html.scrape_udf(page, url, F.when(kind == 2, "p.mine").otherwise("")).alias("content"))
