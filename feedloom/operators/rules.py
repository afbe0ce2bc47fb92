"""Block and keep rules: a mini-language of one ``Type=pattern`` a line, compiled to a Column."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types of a rule and the columns that they read.
TYPES = {"EntryTitle": "title", "EntryURL": "url", "EntryCommentsURL": "comments_url", "EntryContent": "content", "EntryAuthor": "author", "EntryTag": "tags", "EntryDate": "published_at"}
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def parse(*texts: str) -> list[tuple[str, str]]:
    """(type, pattern) of all lines in order; lines without both are skipped."""
    out = []
    for line in (line for text in texts for line in (text or "").replace("\r\n", "\n").split("\n")):
        kind, found, pattern = line.strip().partition("=")
        if found and kind.strip() and pattern.strip():
            out.append((kind.strip(), pattern.strip()))
    return out


def duration(text: str) -> timedelta:
    """``3d`` is days, a bare ``d`` nothing; otherwise numbers with units from ns to h, as in 1h30m."""
    text = text.strip()
    if text.endswith("d"):
        return timedelta(days=int(text[:-1] or 0))
    if text == "0":
        return timedelta()
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {text}")
    return timedelta(seconds=sign * sum(float(n) * _UNITS[u] for n, u in parts))


def valid(spark, pattern: str) -> bool:
    """Whether Spark's regular expressions take the pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  py4j wraps the syntax error
        return False
    return True


def _date(text: str) -> datetime | None:
    try:
        return datetime.strptime(text.strip(), "%Y-%m-%d")
    except ValueError:
        return None


def date_rule(pattern: str, column: str, as_of: datetime) -> Column:
    """future; before:day; after:day; between:day,day (both exclusive); max-age:duration. Anything else never matches."""
    c, no = F.col(column), F.lit(False)
    kind, _, value = pattern.partition(":")
    if pattern == "future":
        return c > F.lit(as_of)
    if kind in ("before", "after"):
        day = _date(value)
        return no if day is None else c < F.lit(day) if kind == "before" else c > F.lit(day)
    if kind == "between":
        days = [_date(x) for x in value.split(",")]
        return (c > F.lit(days[0])) & (c < F.lit(days[1])) if len(days) == 2 and None not in days else no
    if kind == "max-age":
        try:
            return c < F.lit(as_of - duration(value))
        except ValueError:
            return no
    return no


def _match(spark, column: str, pattern: str) -> Column:
    if not valid(spark, pattern):
        return F.lit(False)
    if column == "tags":
        return F.coalesce(F.exists("tags", lambda t: t.rlike(pattern)), F.lit(False))
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def typed(spark, rules: list[tuple[str, str]], as_of: datetime) -> Column:
    """Whether any rule matches; unknown types and invalid patterns never do."""
    found = F.lit(False)
    for kind, pattern in rules:
        if kind == "EntryDate":
            found = found | F.coalesce(date_rule(pattern, TYPES[kind], as_of), F.lit(False))
        elif kind in TYPES:
            found = found | _match(spark, TYPES[kind], pattern)
    return found


def anywhere(spark, pattern: str) -> Column:
    """The feed-wide pattern: URL, title, author or any tag."""
    found = F.lit(False)
    for column in ("url", "title", "author", "tags"):
        found = found | _match(spark, column, pattern)
    return found


def blocked(spark, as_of: datetime, block_rules: str = "", keep_rules: str = "", blocklist: str = "", keeplist: str = "") -> Column:
    """Block rules come first, then the blocklist; with keep rules only their matches stay; else a valid keeplist decides."""
    block, keep = parse(block_rules), parse(keep_rules)
    out = typed(spark, block, as_of)
    if blocklist:
        out = out | anywhere(spark, blocklist)
    if keep:
        return out | ~typed(spark, keep, as_of)
    if keeplist and valid(spark, keeplist):
        return out | ~anywhere(spark, keeplist)
    return out


def apply(entries: DataFrame, as_of: datetime, **rules: str) -> DataFrame:
    return entries.filter(~blocked(entries.sparkSession, as_of, **rules))
