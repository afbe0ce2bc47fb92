"""URL functions."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.udf import pandas_function

# Query parameters that only track, and prefixes of such.
TRACKING = frozenset(
    "fbclid _openstat fb_action_ids fb_action_types fb_ref fb_source fb_comment_id hmb_campaign hmb_medium hmb_source "
    "itm_campaign itm_medium itm_source gclid dclid gbraid wbraid gclsrc campaign_id campaign_medium campaign_name "
    "campaign_source campaign_term campaign_content srsltid yclid ysclid twclid msclkid mc_cid mc_eid mc_tc wickedid "
    "hsa_cam _hsenc __hssc __hstc __hsfp _hsmi hsctatracking rb_clickid oly_anon_id oly_enc_id vero_id vero_conv mkt_tok "
    "sc_cid _bhlid _branch_match_id _branch_referrer".split()
)
TRACKING_PREFIXES = ("utm_", "mtm_")
OUTBOUND = frozenset(["ref"])


def clean_url(url: str, feed_host: str = "", site_host: str = "") -> str:
    """Without tracking parameters; the rest is sorted and encoded anew only if something was removed."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    if not parts.query:
        return url
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    own = {h for h in (feed_host, site_host) if h}
    gone = {k for k, v in pairs if k.lower() in TRACKING or k.lower().startswith(TRACKING_PREFIXES) or k.lower() in OUTBOUND and v in own}
    if not gone:
        return url
    kept = sorted(((k, v) for k, v in pairs if k not in gone), key=lambda p: p[0])
    return urlunsplit(parts._replace(query="&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept)))


def clean_url_column(url: Column) -> Column:
    """The same for plain queries (no encoded characters), without a UDF; hosts of feeds aside."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.split(query, "&")
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    bad = lambda p: key(p).isin(*sorted(TRACKING)) | key(p).rlike("^(utm_|mtm_)")
    kept = F.array_sort(F.filter(pairs, lambda p: ~bad(p)))
    base, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    new = F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(""), rest)
    return F.when((query != "") & F.exists(pairs, bad), new).otherwise(url)


@pandas_function("string")
def clean_url_udf(url: pd.Series, feed_url: pd.Series, site_url: pd.Series) -> pd.Series:
    return pd.Series([clean_url(u, host_of(f), host_of(s)) if u else u for u, f, s in zip(url, feed_url, site_url, strict=True)])


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def domain(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def domain_without_www(url: Column) -> Column:
    return F.regexp_replace(domain(url), r"^www\.", "")


def root_url(url: Column) -> Column:
    """Scheme and host with a slash, else the URL itself."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/"))).otherwise(url)


def is_absolute(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def scheme_allowed(url: Column, schemes: tuple[str, ...] = ("http", "https", "mailto", "tel", "magnet", "ftp", "xmpp", "geo", "sms")) -> Column:
    return F.lower(F.substring_index(url, ":", 1)).isin(*schemes) & url.contains(":")


def resolve(base: str, url: str) -> str | None:
    """``url`` seen from ``base``; null if either is no URL."""
    try:
        return urljoin(base, url.strip())
    except ValueError:
        return None


@pandas_function("string")
def resolve_udf(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([resolve(b or "", u) if u is not None else None for b, u in zip(base, url, strict=True)])


def rewrite_rule(rule: str) -> tuple[str, str] | None:
    """rewrite("pattern"|"replacement") as a pair, or nothing if the rule isn't one."""
    import re

    m = re.fullmatch(r'rewrite\("(.*)"\|"(.*)"\)', rule.strip())
    return (m[1].replace('\\\\', '\\'), re.sub(r"\$\{(\d+)\}", r"$\1", m[2])) if m else None


def rewrite_url(url: Column, rule: str) -> Column:
    pair = rewrite_rule(rule)
    return F.regexp_replace(url, *map(F.lit, pair)) if pair else url


def long_item_id(entry_id: Column) -> Column:
    """The long form of an item id: sixteen hex digits."""
    return F.concat(F.lit("tag:google.com,2005:reader/item/"), F.lpad(F.lower(F.hex(entry_id)), 16, "0"))


def parse_item_id(item: Column) -> Column:
    """From the long form, sixteen hex digits, or a decimal number."""
    tail = F.regexp_replace(item, "^tag:google.com,2005:reader/item/", "")
    is_hex = item.startswith("tag:") | (F.length(tail) == 16)
    return F.when(is_hex, F.conv(tail, 16, 10)).otherwise(tail).try_cast("long")
