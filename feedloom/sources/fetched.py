"""Fetched pages as a table (url, status, headers): whether they changed, where they redirect, when to come again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

REDIRECTS = (301, 302, 303, 307, 308)


def header(headers: Column, name: str) -> Column:
    """A header by its name in lower case; '' if it is missing. headers: map of lower-case names."""
    return F.coalesce(F.element_at(headers, name), F.lit(""))


def etag(headers: Column) -> Column:
    """'' for pages that want no cache."""
    return F.when(header(headers, "expires") == "0", "").otherwise(header(headers, "etag"))


def last_modified(headers: Column) -> Column:
    return F.when(header(headers, "expires") == "0", "").otherwise(header(headers, "last-modified"))


def is_modified(status: Column, headers: Column, old_etag: Column, old_modified: Column) -> Column:
    """Not with status 304; else by the ETag if there is one, else by Last-Modified, else always."""
    tag, changed = etag(headers), last_modified(headers)
    return F.when(status == 304, False).when(tag != "", tag != old_etag).when(changed != "", changed != old_modified).otherwise(True)


def is_redirect(status: Column) -> Column:
    return status.isin(*REDIRECTS)


def is_rate_limited(status: Column) -> Column:
    return status == 429


def _http_date(text: Column) -> Column:
    """A date as in Thu, 02 Jun 2016 20:33:25 GMT; null for anything else."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC)$", 1), F.lit("dd MMM yyyy HH:mm:ss"))


def retry_seconds(headers: Column, as_of: datetime) -> Column:
    """Retry-After as seconds or as a date; 0 without it."""
    text = header(headers, "retry-after")
    until = F.unix_timestamp(_http_date(text)) - F.unix_timestamp(F.lit(as_of))
    return F.coalesce(text.try_cast("long"), until, F.lit(0)).cast("long")


def max_age_seconds(headers: Column) -> Column:
    """The first max-age of Cache-Control; 0 without one."""
    parts = F.transform(F.split(header(headers, "cache-control"), ","), lambda x: F.regexp_extract(F.trim(x), r"^max-age=(-?\d+)$", 1).try_cast("long"))
    return F.coalesce(F.get(F.filter(parts, lambda x: x.isNotNull()), 0), F.lit(0))


def expires_seconds(headers: Column, as_of: datetime) -> Column:
    """Until Expires, rounded up to a minute; 0 without a date."""
    seconds = F.unix_timestamp(_http_date(header(headers, "expires"))) - F.unix_timestamp(F.lit(as_of))
    whole = F.when(seconds >= 0, F.floor(seconds / 60)).otherwise(F.ceil(seconds / 60))
    return F.coalesce((whole + 1) * 60, F.lit(0)).cast("long")
