from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import dates, html, rewrite, text, urls
from feedloom.operators import rules


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first()["x"]


def test_extract_text():
    assert text.extract_text("<p>One</p><p>two&nbsp;three</p><script>x()</script><ul><li>a<li>b</ul>") == "One two three a b"
    assert text.extract_text("<!-- no --><b>bo</b>ld") == "bold"


SENTENCE = "The quick brown fox jumps over the lazy dog. "


def test_split_round_trips_and_overlaps():
    whole = SENTENCE * 200
    parts = text.split(whole)
    data = whole.encode()
    assert all(data[a:b].decode() == t for t, a, b in parts)
    assert parts[0][1] == 0 and parts[-1][2] == len(data.rstrip())
    assert all(nxt[1] < cur[2] for cur, nxt in zip(parts, parts[1:], strict=False))
    assert all(len(t.split()) <= 512 for t, _, _ in parts)


def test_split_keeps_a_long_sentence_whole():
    assert len(text.split("word " * 700 + "end. Short one.")) == 2
    assert text.split("  ") == []
    assert [t for t, _, _ in text.split("Ein Satz. Ünd ohne Ende")] == ["Ein Satz. Ünd ohne Ende"]


@given(st.text(max_size=300))
def test_split_slices(t):
    data = t.encode()
    for part, a, b in text.split(t, 5, 8, 2):
        assert data[a:b].decode() == part and part == part.strip(" \t\n\r\v\f")


def test_highlights_and_snippet():
    assert text.highlights("Grüße an Anna, anna!", "anna xy") == [(11, 15), (17, 21)]
    assert text.highlights("aaaa", "aaa") == [(0, 4)]
    assert text.snippet("Title here", "Title here", 0, 5, True, "title") == ("Title", [(0, 5)])
    got, marks = text.snippet("ü" * 400 + " needle " + "x" * 400, "old", 0, 3, False, "needle")
    assert "needle" in got and len(got.encode()) <= 320 and got.encode()[marks[0][0] : marks[0][1]] == b"needle"
    assert text.snippet("nothing", "old", 0, 3, False, "needle") == ("old", [])
    assert text.segments("ab cd", [(3, 5)]) == [("ab ", False), ("cd", True)]


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("one two three", 1),
        ("word " * 800, 4),
        ("漢字" * 600, 3),
        ("", 0),
        ('<a title="' + "x " * 600 + '">two words</a>', 1),
        ("<p>" + "word " * 265 + "</p>", 1),
        ("漢" * 50 + "a" * 50, 1),
        ("漢" * 51 + "a" * 1449, 3),
        ("ㄅ" * 1001, 3),
        ("ꀀ" * 1001, 3),
    ],
)
def test_reading_time(spark, t, want):
    assert one(spark, text.reading_time(F.col("t")), t=t) == want


def test_small_columns(spark):
    assert one(spark, text.normalize_language(F.col("t")), t=" EN_us ") == "en-us"
    assert one(spark, text.normalize_language(F.col("t")), t="en us!") == ""
    assert one(spark, text.truncate_bytes(F.col("t"), 4), t="aéé") == "aé"
    assert one(spark, text.truncate_html(F.col("t"), 5), t="<p>Hello  big world</p>") == "Hello…"
    assert one(spark, text.podcast_minutes(F.col("t")), t="1:02:30") == 62
    assert one(spark, text.podcast_minutes(F.col("t")), t="1:2:3:4") is None
    assert one(spark, text.iso_minutes(F.col("t")), t="PT1H5M30S") == 65
    assert one(spark, text.iso_minutes(F.col("t")), t="P1D") is None
    assert one(spark, text.valid_xml(F.col("t")), t="a\x0bb\x01c") == "abc"
    assert text.decode_bytes(b"caf\xe9", "iso-8859-1") == "café"
    assert text.decode_bytes("é".encode()) == "é"


def test_urls(spark):
    assert urls.clean_url("https://e.org/?b=2&UTM_source=x&a=1#f") == "https://e.org/?a=1&b=2#f"
    assert urls.clean_url("https://e.org/?b=2&a=1") == "https://e.org/?b=2&a=1"
    assert urls.clean_url("https://e.org/?fbclid=1") == "https://e.org/"
    assert urls.clean_url("https://e.org/?ref=my.org", "my.org") == "https://e.org/"
    assert urls.clean_url("https://e.org/?ref=other.org", "my.org") == "https://e.org/?ref=other.org"
    assert one(spark, urls.long_item_id(F.col("t").cast("long")), t="255") == "tag:google.com,2005:reader/item/00000000000000ff"
    for t in ("tag:google.com,2005:reader/item/00000000000000ff", "00000000000000ff", "255"):
        assert one(spark, urls.parse_item_id(F.col("t")), t=t) == 255
    assert urls.rewrite_rule('rewrite("^a(.)"|"b${1}")') == ("^a(.)", "b$1")
    assert one(spark, urls.rewrite_url(F.col("t"), 'rewrite("^a(.)"|"b$1")'), t="axe") == "bxe"


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("Sat, 04 Jan 2014 13:45:00 EST", datetime(2014, 1, 4, 18, 45)),
        ("2017-12-22T22:09:49+00:00", datetime(2017, 12, 22, 22, 9, 49)),
        ("Thu, 02 Jun 2016 20:33:25 GMT", datetime(2016, 6, 2, 20, 33, 25)),
        ("1332841834", datetime(2012, 3, 27, 9, 50, 34)),
        ("2 février 2018", datetime(2018, 2, 2)),
        ("2015-01-01 10:00:00", datetime(2015, 1, 1, 10)),
        ("2015-01-01T10:00:00+23:00", datetime(2014, 12, 31, 11)),  # told in UTC, the moment stays
        ("Tue, 03 Mar 2020 1:55 PM EST", datetime(2020, 3, 3, 13, 55)),
        ("Freitag", None),
        ("Mon, 04/13/2020 - 19:19", datetime(2020, 4, 13, 19, 19)),
        ("Fr, 26/06/2020", datetime(2020, 6, 26)),
        ("mar., 3 mars 2020 10:00:00 +0200", datetime(2020, 3, 3, 8)),
        ("Lundi, 16. Novembre 2020 - 15:54", datetime(2020, 11, 16, 15, 54)),
        ("12/31/99 23:59:58", datetime(1999, 12, 31, 23, 59, 58)),
        ("31.12.68", datetime(2068, 12, 31)),
        ("Sat, 23rd May 2020 09:32:20 GMT-07:00", datetime(2020, 5, 23, 16, 32, 20)),
        ("Sept. 2021", datetime(2021, 9, 1)),
        ("Sat May 2 15:04:05 2020 CEST", datetime(2020, 5, 2, 15, 4, 5)),
    ],
)
def test_dates(t, want):
    if want is None:
        with pytest.raises(ValueError):
            dates.parse_date(t)
        return
    assert dates.parse_date(t) == want.replace(tzinfo=timezone.utc)


def test_bad_dates(spark):
    for t in ("", "yesterday", "99 Foo 2020"):
        with pytest.raises(ValueError):
            dates.parse_date(t)
    assert str(one(spark, dates.parse_common(F.col("t")), t="Thu, 02 Jun 2016 20:33:25 GMT")) == "2016-06-02 20:33:25"
    assert one(spark, dates.parse_common(F.col("t")), t="no date") is None
    assert one(spark, dates.parse_date_udf(F.col("t")), t="no date") is None


def test_durations():
    assert rules.duration("3d") == timedelta(days=3) and rules.duration("d") == timedelta()
    assert rules.duration("1h30m") == timedelta(minutes=90)
    with pytest.raises(ValueError):
        rules.duration("soon")


def test_rules_parse_and_match(spark):
    assert rules.parse("EntryTitle = a=b\r\n\r\nbad\nEntryTag=x", "EntryURL=") == [("EntryTitle", "a=b"), ("EntryTag", "x")]
    df = spark.createDataFrame([("Golang news", "https://e.org", ["go"], datetime(2024, 1, 1)), ("Other", "https://x.org", ["py"], datetime(2024, 1, 5))], "title string, url string, tags array<string>, published_at timestamp")
    df = df.withColumns({"author": F.lit("a"), "content": F.lit("c"), "comments_url": F.lit("")})
    left = lambda **k: sorted(r["title"] for r in rules.apply(df, datetime(2024, 1, 6), **k).collect())
    assert left(block_rules="EntryTitle=(?i)golang") == ["Other"]
    assert left(keep_rules="EntryTag=^py$") == ["Other"]
    assert left(block_rules="EntryTitle=(", blocklist="x\\.org") == ["Golang news"]
    assert left(keeplist="e\\.org") == ["Golang news"] and len(left(keeplist="(")) == 2
    assert left(block_rules="EntryDate=max-age:3d") == ["Other"]
    assert left(block_rules="EntryDate=between:2024-01-04,2024-01-06") == ["Golang news"]


def test_sanitize():
    got = html.sanitize('<p onclick="x">a<script>b</script><blink>c</blink><a href="/x?y">d</a><a href="javascript:1">e</a></p>', "https://e.org/p/")
    assert got == '<p>ac<a href="https://e.org/x?y" rel="noopener noreferrer" referrerpolicy="no-referrer" target="_blank">d</a>e</p>'
    assert html.sanitize('<img src="https://e.org/p.gif" width="1" height="1"><img src="/i.png">', "https://e.org") == '<img src="https://e.org/i.png" loading="lazy">'
    assert "iframe" not in html.sanitize('<iframe src="https://evil.example/"></iframe>') and "iframe" in html.sanitize('<iframe src="https://www.youtube.com/embed/1"></iframe>')
    assert html.candidates("a.png 1x, b,c.png 200w, bad 3q") == [("a.png", "1x"), ("b,c.png", "200w")]


def test_readable():
    page = '<body><div class="menu"><p>Home, about, all the other things of it</p></div><div class="post"><p>{}</p><p>{}</p></div></body>'.format("A long text, with commas, of an article. " * 5, "More of it, and more. " * 6)
    got = html.readable(page)
    assert "long text" in got and "More of it" in got and "Home" not in got


def test_bad_urls_and_deep_markup_do_no_harm():
    assert html.sanitize('<img src="http://[x"><a href="http://[x">l</a><iframe src="http://[x"></iframe><img srcset="http://[x 2x">') == "l"
    assert html.sanitize("<p>a</p>", "http://[x") == "<p>a</p>" and urls.clean_url("http://[x?utm_source=1") == "http://[x?utm_source=1"
    assert html.feed_links('<link rel="alternate" type="application/rss+xml" href="http://[x">', "https://e.org/") == [] and html.icon_links('<link rel="icon" href="http://[x">', "") == []
    deep = "<div><p>word, and more words to count here</p>" * 10_000
    assert html.sanitize(deep).count("<p>") == 10_000 and "word" in html.readable(deep)
    assert rewrite.rewrite_elements(deep, [("remove_tables", ()), ("remove", ("p",))]).count("<div>") == 10_000 and text.extract_text(deep)


def test_sanitize_as_the_rules_say():
    assert html.sanitize('<img src="data:image/png;base64,AA"><img src="data:text/html,x">') == '<img src="data:image/png;base64,AA" loading="lazy">'
    assert html.sanitize('<p hidden>x</p><div>"y" &amp; z</div>') == "&#34;y&#34; &amp; z"
    assert html.sanitize('<img src="https://e.org/a.png" width="1" height="20" decoding="async" fetchpriority="no">') == '<img src="https://e.org/a.png" width="1" height="20" decoding="async" loading="lazy">'
    assert html.sanitize('<video src="https://e.org/v.mp4"></video>') == '<video src="https://e.org/v.mp4" controls></video>'
    assert html.sanitize('<a href="https://twitter.com/share?x">t</a><a href="#n">n</a>') == 't<a href="#n">n</a>'
    assert html.sanitize('<iframe src="//player.vimeo.com/video/1"></iframe>').startswith('<iframe src="//player.vimeo.com/video/1?dnt=1" sandbox=')
    assert html.candidates("a.png 100w 50h, b.png 1.5x") == [("a.png", "100w 50h"), ("b.png", "1.5x")]


def test_selectors():
    page = '<div id="a"><h6 class="byline">1</h6><h6>2</h6><p>x<b class="k">y</b></p><p>z</p></div>'
    assert html.select(page, "h6:not(.byline, .other)") == "<h6>2</h6>" and html.select(page, "p:has(.k)") == '<p>x<b class="k">y</b></p>'
    assert html.select(page, "#a > p + p, h6:nth-child(1)") == '<h6 class="byline">1</h6><p>z</p>' and html.select(page, "p b:only-child") == '<b class="k">y</b>'
    assert html.select('<img src="/assets/c/1"><img src="/b">', "img[src^='/assets/c/']") == '<img src="/assets/c/1"/>'


def test_links():
    page = '<head><link rel="alternate" type="application/rss+xml" href="/f.xml" title="F"><link rel="icon" href="/i.png"></head>'
    assert html.feed_links(page, "https://e.org/") == [("F", "https://e.org/f.xml", "rss")]
    assert html.icon_links(page, "https://e.org/") == ["https://e.org/i.png"]
    assert html.select('<div class="a"><p>x</p></div><p>y</p>', "div.a > p") == "<p>x</p>"
    assert "proxy/" in html.proxied('<img src="http://e.org/i.png">', "/proxy/") and "proxy" not in html.proxied('<img src="https://e.org/i.png">', "/proxy/")


def test_rewrite_rules_on_elements():
    do = lambda page, name, *a: rewrite.rewrite_elements(page, [(name, a)])
    assert do('<div data-src="x.jpg" alt="a"></div>', "add_dynamic_image") == '<img src="x.jpg" alt="a"/>'
    assert do('<noscript><img src="n.png"></noscript>', "add_dynamic_image") == '<img src="n.png"/>'
    assert do('<iframe data-lazy-src="v"></iframe>', "add_dynamic_iframe") == '<iframe data-lazy-src="v" src="v"></iframe>'
    assert do("<p><span>SGVsbG8=</span>no!</p>", "base64_decode") == "<p><span>Hello</span>no!</p>"
    assert do('<p><a href="https://news.ycombinator.com/user?id=x">u</a> t</p>', "add_hn_links_using_hack") == '<p><a href="https://news.ycombinator.com/user?id=x">u</a> t <a href="hack://user?id=x">Open with HACK</a></p>'
    assert "opener://x-callback-url/show-options?url=https%3A%2F%2Fnews.ycombinator.com%2Fitem%3Fid%3D1" in do('<p><a href="https://news.ycombinator.com/item?id=1">u</a></p>', "add_hn_links_using_opener")
    assert do('<a href="mailto:x@e.org?subject=Hi there">m</a>', "add_mailto_subject") == '<a href="mailto:x@e.org?subject=Hi there">m [Hi there]</a>'
    assert do('<img src="https://e.org/a.png?w=9&blur=20"><img src="https://e.org/a.png?blur=0">', "remove_img_blur_params") == '<img src="https://e.org/a.png"/><img src="https://e.org/a.png?blur=0"/>'
    card = '<figure class="kg-card"><a class="kg-bookmark-container" href="{0}"><div class="kg-bookmark-title">T{0}</div><span class="kg-bookmark-author">A</span></a></figure>'
    assert do(card.format("u"), "fix_ghost_cards") == '<a href="u">Tu - A</a>'
    assert do(card.format("u") + card.format("v") + "<p>x</p>", "fix_ghost_cards") == '<ul><li><a href="u">Tu - A</a></li><li><a href="v">Tv - A</a></li></ul><p>x</p>'
    assert do('<figure><img src="small"><noscript><img src="big"></noscript></figure>', "use_noscript_figure_images") == '<figure><img src="big"/></figure>'
    assert do('<figure class="paragraph-image"><noscript><img src="big"></noscript></figure>', "fix_medium_images") == '<img src="big"/>'


def test_rewrite_by_domain(spark):
    rows = [("t", "https://www.xkcd.com/1", '<img src="s.png" title="T">'), ("t", "https://e.org/1", '<img src="s.png" title="T">'), ("t", "https://medium.com/x", '<figure class="paragraph-image"><noscript><img src="b"></noscript></figure>')]
    df = spark.createDataFrame(rows, "title string, url string, content string")
    got = {r["url"]: r["content"] for r in rewrite.apply_by_domain(df).collect()}
    assert "figcaption" in got[rows[0][1]] and got[rows[1][1]] == rows[1][2] and got[rows[2][1]] == '<img src="b"/>'
    assert all("figcaption" not in r["content"] for r in rewrite.apply_by_domain(df, "nl2br").collect())


def test_rewrite(spark):
    assert rewrite.rules('nl2br,replace("a\\"b"|"c"), remove(".x")') == [("nl2br", ()), ("replace", ('a"b', "c")), ("remove", (".x",))]
    df = spark.createDataFrame([("A TITLE", "https://www.youtube.com/watch?v=abc", 'x\n<div class="x">gone</div><img src="s.png" title="T">')], "title string, url string, content string")
    got = rewrite.apply(df, 'nl2br,remove(".x"),add_image_title,remove_clickbait,add_youtube_video,nonsense').first()
    assert got["title"] == "A Title" and got["content"].startswith("<iframe") and "gone" not in got["content"] and "<figcaption><p>T</p></figcaption>" in got["content"] and "<br" in got["content"]
    pdf = spark.createDataFrame([("t", "https://e.org/a.pdf", "c")], "title string, url string, content string")
    assert rewrite.apply(pdf, "").first()["content"].startswith('<a href="https://e.org/a.pdf">')
    assert rewrite.rewrite_elements("<table><tr><td>a</td></tr></table>", [("remove_tables", ())]) == "a"
    assert rewrite.rewrite_elements('<img data-src="l.png">', [("add_dynamic_image", ())]) == '<img data-src="l.png" src="l.png"/>'


def test_media_of_items_and_groups():
    from feedloom.sources import formats

    ns = "xmlns:media='http://search.yahoo.com/mrss/' xmlns:itunes='http://www.itunes.com/dtds/podcast-1.0.dtd'"
    doc = f"""<rss version='2.0' {ns}><channel><link>https://a.example/</link><itunes:owner><itunes:email>o@a.example</itunes:email></itunes:owner><itunes:category text='A'><itunes:category text=' '><itunes:category text='C'/></itunes:category></itunes:category>
    <item><guid>1</guid><media:category label=' x '/><media:content url='/1' medium='image'/><media:group><media:content url='/2' type='t/u' fileSize='x'/><media:peerLink href='/1'/><media:description type='html'>&lt;b&gt;</media:description></media:group></item>
    <item><guid>2</guid><media:description> a https://x.example/y
b</media:description></item></channel></rss>"""
    one, two = formats.parse_feed(doc, "https://a.example/f")
    assert [(e["url"], e["mime_type"], e["size"]) for e in one["enclosures"]] == [("https://a.example/1", "image/*", 0), ("https://a.example/2", "t/u", 0)]
    assert one["content"] == "<b>" and one["tags"] == ["x"] and one["author"] == "o@a.example"
    assert two["content"] == ' a <a href="https://x.example/y">https://x.example/y</a><br>b' and two["tags"] == ["A", "C"]
    first = formats.episodes(doc, "https://a.example/f")[0]
    assert [(c["name"], c["above"], c["depth"]) for c in first["categories"]] == [("A", "", 1), ("C", "A", 2)]
    assert formats.episodes("<rss") == [] and formats.episodes("<feed/>") == []


def test_charsets():
    from feedloom.functions.text import decode_bytes

    assert decode_bytes("é".encode(), "iso-8859-1") == "é"  # UTF-8 whatever is said
    assert decode_bytes(b"\x93caf\xe9\x94", "text/html; charset=iso-8859-1") == "\u201ccaf\xe9\u201d"  # the web's Latin-1
    assert decode_bytes(b"a\x81\xe9") == "a\x81\xe9"
    assert decode_bytes("\ufeffhé".encode("utf-16-le")) == "hé" and decode_bytes("\ufeffhé".encode("utf-16-be")) == "hé"
    assert decode_bytes(b"<?xml encoding='koi8-r'?>" + "да".encode("koi8-r")).endswith("да")
    assert decode_bytes("да".encode("cp1251"), "text/xml; charset=windows-1251") == "да"
    assert decode_bytes(b"\xff\x41", "nonsense") == "\xffA" and decode_bytes(b"") == ""
    assert decode_bytes("日本".encode("shift_jis") + b"\x81", "shift_jis") == "日本\ufffd"


def test_letters_beyond_the_first_thousand_characters(spark):
    from pyspark.sql import functions as F

    from feedloom.functions.text import reading_time

    rows = [("1 " * 600 + "漢字" * 300,), ("1 " * 600 + "word " * 300,), ("漢" * 60 + "a" * 39 + " b" * 2000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(reading_time(F.col("t"))).collect()]
    assert got == [4, 4, 9]


def test_site_selectors_can_be_run():
    from feedloom.functions import html as H

    page = "<div class='post-content'><p>x</p></div><article><p>y</p></article>"
    for domain, rule in H.SITE_SELECTORS.items():
        assert H.scrape(page, f"https://www.{domain}/1") == H.select(page, rule)
    assert H.scrape(page, "https://arstechnica.com/1") == '<div class="post-content"><p>x</p></div>' and H.scrape(page, "https://lemonde.fr", "p") == "<p>x</p><p>y</p>"
    assert H.scrape(page, "https://unknown.example/") == H.readable(page)
