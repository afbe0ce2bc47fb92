"""Text functions: Columns where Spark's functions can express them, plain Python (for pandas UDFs) where not."""

from __future__ import annotations

import math
import re
import unicodedata
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.udf import pandas_function

#: Tags that part words, and tags whose text isn't shown.
BLOCK_TAGS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript".split())
_BLANK = re.compile("[\\s\\ufeff]+")
_SPACES = b" \t\n\r\v\f"
MOST_LANGUAGE = 35


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden.append(tag)
        elif tag in BLOCK_TAGS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif tag in BLOCK_TAGS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def extract_text(html: str) -> str:
    """The text of an HTML fragment: a space on each side of block tags, runs of white space as one."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return _BLANK.sub(" ", "".join(parser.parts)).strip(" ")


def sentence_spans(data: bytes) -> list[tuple[int, int]]:
    """Byte spans: a sentence ends at . ! or ? before white space or the end; what is left is the last one."""
    spans, start, n = [], 0, len(data)
    for m in re.finditer(rb"[.!?](?=[ \t\n\r\v\f]|$(?![\n]))", data):
        s = start
        while s < n and data[s] in _SPACES:
            s += 1
        if m.end() > s:
            spans.append((s, m.end()))
            start = m.end()
    s = start
    while s < n and data[s] in _SPACES:
        s += 1
    e = n
    while e > s and data[e - 1] in _SPACES:
        e -= 1
    if e > s:
        spans.append((s, e))
    return spans


def split(text: str, target: int = 320, most: int = 512, overlap: int = 64, counter=None) -> list[tuple[str, int, int]]:
    """(text, start, end in bytes): passages of whole sentences that overlap; a long sentence stands alone."""
    data = text.encode()
    spans = sentence_spans(data)
    size = [counter(data[a:b].decode()) if counter else len(data[a:b].decode().split()) for a, b in spans]
    out, first = [], 0
    while first < len(spans):
        total, stop = 0, first
        while stop < len(spans) and (stop == first or total + size[stop] <= most):
            total += size[stop]
            stop += 1
            if total >= target:
                break
        a, b = spans[first][0], spans[stop - 1][1]
        out.append((data[a:b].decode(), a, b))
        if stop >= len(spans):
            break
        back, kept = stop - 1, 0
        while back > first and kept < overlap:
            kept += size[back]
            back -= 1
        first = back + 1
    return out


@pandas_function("string")
def extract_text_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda h: extract_text(h) if h is not None else None)


@pandas_function("array<struct<text:string,start:int,end:int>>")
def split_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"text": x, "start": a, "end": b} for x, a, b in split(t)] if t is not None else None)


def word_count(text: Column) -> Column:
    """Words between ASCII white space, without a UDF."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


#: Comments, declarations and tags; a < before anything but a letter, /, ! or ? is text. Quoted values may hold a >.
TAGS = r"(?s)<!--.*?-->|<[!?][^>]*>|</?[A-Za-z](?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+(?:>|$)"
SPACES = r"[\s\x{85}\p{Z}]+"


def strip_tags(html: Column) -> Column:
    """Text outside tags as it stands (references and scripts too), trimmed of any white space; no parser is needed."""
    return F.regexp_replace(F.regexp_replace(html, TAGS, ""), f"^{SPACES}|{SPACES}$", "")


def minify(html: Column) -> Column:
    """Without comments, and runs of white space as one space; text in pre and textarea elements stays as it is."""
    parts = F.split(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)(?=<(?:pre|textarea)\b)|(?<=</pre>|</textarea>)")
    raw = lambda x: F.lower(F.substring(x, 1, 9)).rlike(r"^<(pre|textarea)")
    return F.trim(F.concat_ws("", F.transform(parts, lambda x: F.when(raw(x), x).otherwise(F.regexp_replace(x, r"\s+", " ")))))


def has_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(strip_tags(html), r"\s+", "")) != ""


def truncate_html(html: Column, limit: int) -> Column:
    """Stripped, white space collapsed, cut to ``limit`` characters with an ellipsis."""
    text = F.trim(F.regexp_replace(strip_tags(html), r"\s+", " "))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def reading_time(html: Column, speed: int | Column = 265, cjk_speed: int | Column = 500) -> Column:
    """Minutes for the text outside tags: by characters if more than half of the first letters are of a Chinese, Japanese or
    Korean script, else by words. Letters are looked at up to the hundredth, which counts but isn't tested."""
    text = strip_tags(html)
    # A hundred letters are nearly always among the first thousand characters; only otherwise the whole text is looked at.
    some = F.regexp_replace(F.substring(text, 1, 1000), r"\P{L}", "")
    enough = (F.length(some) >= 100) | (F.length(text) <= 1000)
    letters = F.substring(F.when(enough, some).otherwise(F.regexp_replace(text, r"\P{L}", "")), 1, 100)
    cjk = F.length(F.regexp_replace(F.substring(letters, 1, 99), r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsYi}\p{IsBopomofo}]", ""))
    many = cjk > F.floor(F.length(letters) / 2)
    words = F.size(F.array_remove(F.split(text, SPACES), ""))
    return F.when(many, F.ceil(F.length(text) / cjk_speed)).otherwise(F.ceil(words / speed)).cast("long")


def normalize_language(language: Column) -> Column:
    """Trimmed, lower case, underscores as hyphens; '' if it is too long or has other characters."""
    t = F.trim(language)
    ok = t.rlike(r"^[A-Za-z0-9_-]*$") & (F.length(t) <= MOST_LANGUAGE)
    return F.when(ok, F.lower(F.replace(t, F.lit("_"), F.lit("-")))).otherwise("")


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that ends between characters."""
    data = F.substring(F.encode(text, "UTF-8"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.rtrim(F.make_valid_utf8(data.cast("string")), F.lit("�")))


def podcast_minutes(duration: Column) -> Column:
    """[h:]m:s to whole minutes; more than three parts, or others than numbers, are null."""
    parts = F.transform(F.split(duration, ":"), lambda x: x.try_cast("int"))
    seconds = F.aggregate(parts, F.lit(0), lambda a, x: a * 60 + x)
    return F.when((F.size(parts) <= 3) & ~F.exists(parts, lambda x: x.isNull()), F.floor(seconds / 60))


def iso_minutes(duration: Column) -> Column:
    """PT#H#M#S to minutes; other parts make it null."""
    got = lambda u: F.coalesce(F.regexp_extract(duration, rf"(\d+){u}", 1).try_cast("double"), F.lit(0.0))
    ok = duration.rlike(r"^PT(\d+H)?(\d+M)?(\d+S)?$") & (duration != "PT")
    return F.when(ok, F.floor((got("H") * 3600 + got("M") * 60 + got("S")) / 60))


def query_terms(query: str) -> list[str]:
    """Runs of letters and digits of at least three characters."""
    out, word = [], ""
    for c in query + " ":
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            word += c
        else:
            out += [word] if len(word) >= 3 else []
            word = ""
    return out


def highlights(text: str, query: str) -> list[tuple[int, int]]:
    """Byte ranges of the query's terms, whatever the case; ranges that overlap or touch are one."""
    folded, at = [], [0]
    for c in text:
        folded.append(c.lower()[:1] if len(c.lower()) > 1 else c.lower())
        at.append(at[-1] + len(c.encode()))
    line, found = "".join(folded), []
    for term in query_terms(query):
        t = "".join(c.lower()[:1] if len(c.lower()) > 1 else c.lower() for c in term)
        i = line.find(t)
        while i >= 0:
            found.append((at[i], at[i + len(t)]))
            i = line.find(t, i + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def snippet(source: str, stored: str, start: int, end: int, unchanged: bool, query: str, window: int = 320) -> tuple[str, list[tuple[int, int]]]:
    """The passage by its offsets if the source is unchanged; else a window at the first term found; else the stored text."""
    data = source.encode()
    edge = lambda i: i in (0, len(data)) or data[i] & 0xC0 != 0x80
    if unchanged and 0 <= start <= end <= len(data) and edge(start) and edge(end):
        text = data[start:end].decode()
        return text, highlights(text, query)
    found = highlights(source, query)
    if not found:
        return stored, []
    a = max(0, found[0][0] - window // 2)
    while not edge(a):
        a += 1
    b = min(len(data), a + window)
    while not edge(b):
        b -= 1
    text = data[a:b].decode() if b > a else data[a:].decode()
    return text, highlights(text, query)


def segments(text: str, ranges: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """The text cut into (piece, highlighted); ranges that don't fit are left out."""
    data, out, last = text.encode(), [], 0
    for a, b in sorted(ranges):
        if last <= a < b <= len(data) and (a == len(data) or data[a] & 0xC0 != 0x80) and (b == len(data) or data[b] & 0xC0 != 0x80):
            out += [(data[last:a].decode(), False)] * (a > last) + [(data[a:b].decode(), True)]
            last = b
    return out + [(data[last:].decode(), False)] * (last < len(data))


#: Charset names that the web reads as Windows-1252.
_WINDOWS = frozenset("ascii us-ascii ansi_x3.4-1968 iso-8859-1 iso8859-1 iso_8859-1 iso88591 latin1 l1 cp1252 cp819 x-cp1252 windows-1252".split())
#: What Windows-1252 has where Latin-1 has controls; bytes that it lacks stay controls.
_EXTRA = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def _windows(data: bytes) -> str:
    return data.decode("latin-1").translate(_EXTRA)


def decode_bytes(data: bytes, declared: str = "") -> str:
    """UTF-8 if valid, whatever is declared; else by a byte order mark, the declared charset (a name, or a content type), one named in the first 1024
    bytes, or Windows-1252. Bytes that a charset lacks become U+FFFD; charsets that aren't known are as if not declared."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    for mark, name in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(mark):
            return data[2:].decode(name, "replace")
    header = re.search(r"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", declared, re.I)
    inside = re.search(rb"""(?:charset|encoding)\s*=\s*["']?([A-Za-z0-9_.:-]+)""", data[:1024], re.I)
    for name in (header[1] if header else declared.strip(), inside[1].decode() if inside else ""):
        if name.lower() in _WINDOWS:
            return _windows(data)
        try:
            if name and not name.lower().startswith("utf-16"):  # without a mark, what is read as bytes so far isn't
                return data.decode(name, "replace")
        except LookupError:
            continue
    return _windows(data)


@pandas_function("string")
def decode_udf(data: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else decode_bytes(bytes(d), c or "") for d, c in zip(data, declared, strict=True)], dtype=object)


def valid_xml(text: Column) -> Column:
    """Without characters that XML 1.0 does not allow."""
    return F.regexp_replace(F.make_valid_utf8(text), r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def plain(html: str) -> str:
    return unescape(re.sub(r"<[^>]*>", "", html)).strip()


def minutes(chars: int, speed: int) -> int:
    return math.ceil(chars / speed)
