"""Feed dates."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.udf import pandas_function

# Names of months by their first letters in English, German and French; of days; places that stand for a zone; and the
# hours of those zones whose names are read (in the formats of RFC 822, 850 and 1123 alone, as others give names without offsets).
MONTHS = (
    ("jan",), ("feb", "fév", "fev"), ("mar", "mär"), ("apr", "avr"), ("may", "mai"), ("jun", "juin"), ("jul", "juil"), ("aug", "aoû", "aou"),
    ("sep",), ("oct", "okt"), ("nov",), ("dec", "déc", "dez"),
)
DAYS = frozenset(
    "mon monday tue tues tuesday wed wednesday thu thur thurs thursday fri friday sat saturday sun sunday mo di mi do fr sa so "
    "lun lundi mar mardi mer mercredi jeu jeudi ven vendredi sam samedi dim dimanche".split()
)
PLACES = {"Europe/Brussels": "CET", "America/Los_Angeles": "PDT", "GMT+0000 (Coordinated Universal Time)": "GMT"}
ZONES = {"PST": -8, "PDT": -7, "EST": -5, "EDT": -4}
_TIME = re.compile(r"(?<![\d.:/+-])(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,]\d+)?)?\s*([ap]\.?m\.?(?![a-z]))?", re.I)
_OFFSET = re.compile(r"(?:GMT|UTC|UT|Z)?\s*(-?[+-])(\d{2}):?(\d{2})?(?::\d{2})?(?:\s*Z)?(?=\s|$)")
_RFC = re.compile(r"[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} ([A-Z]{3})|\d{2} [A-Za-z]{3} \d{2} \d{2}:\d{2} ([A-Z]{3})|[A-Z][a-z]+, \d{2}-[A-Z][a-z]{2}-\d{2} \d{2}:\d{2}:\d{2} ([A-Z]{3})")


def _month(word: str) -> int:
    return next((i for i, names in enumerate(MONTHS, 1) if word.lower().startswith(names)), 0)


def _year(text: str) -> int:
    n = int(text)
    return n if len(text) > 2 else n + (1900 if n >= 69 else 2000)


def _day(rest: str, american: bool) -> tuple[int, int, int]:
    """Year, month and day of what is left without time and zone. Of two numbers that may be either the first is the day, unless ``american``."""
    words = [w for w in re.findall(r"[^\W\d_]+|\d+", re.sub(r"(?<=\d)(?:st|nd|rd|th)\b", "", rest)) if not (w.lower() in DAYS and not (w.lower() == "mar" and re.search(rf"\d\W+{w}", rest)))]
    months = [m for m in map(_month, (w for w in words if not w.isdigit())) if m]
    numbers = [w for w in words if w.isdigit()]
    if months:
        year = next((n for n in numbers if len(n) == 4), numbers[-1] if len(numbers) > 1 else "")
        if not year:
            raise ValueError(rest)
        others = list(numbers)
        others.remove(year)
        return _year(year), months[0], int(others[0]) if others else 1
    if len(numbers) == 1 and len(numbers[0]) == 8:
        return int(numbers[0][:4]), int(numbers[0][4:6]), int(numbers[0][6:])
    if len(numbers) != 3:
        raise ValueError(rest)
    if len(numbers[0]) == 4 or len(numbers[1]) == len(numbers[2]) == 1:
        return _year(numbers[0]), int(numbers[1]), int(numbers[2])
    one, two, year = int(numbers[0]), int(numbers[1]), _year(numbers[2])
    month, day = (one, two) if american else (two, one)
    return (year, month, day) if month <= 12 else (year, day, month)


def parse_date(text: str) -> datetime:
    """A feed's date in UTC, whatever its offset; whole numbers are unix seconds.

    Time and zone are found first, then names of days are left out and the order of the numbers tells the day. Names of zones
    count only in the formats of mail and news (RFC 822, 850, 1123); elsewhere they stand for UTC.
    """
    t = re.sub(r"\s+", " ", text.strip())
    if re.fullmatch(r"[+-]?\d+", t):
        return datetime.fromtimestamp(int(t), timezone.utc)
    for place, zone in PLACES.items():
        t = t.replace(place, zone)
    rfc = _RFC.fullmatch(t)
    named = ZONES.get((rfc[1] or rfc[2] or rfc[3]) if rfc else "", 0)
    t = re.sub(r"(?<=\d)T(?=\d)", " ", t).replace(" at ", " ")
    time = _TIME.search(t)
    hour = minute = second = 0
    offset = timedelta(hours=named)
    rest = t
    if time:
        hour, minute, second = int(time[1]), int(time[2]), int(time[3] or 0)
        if time[4]:
            hour = hour % 12 + (12 if time[4][0] in "pP" else 0)
        after = t[time.end() :].lstrip(" :")
        found = _OFFSET.match(after)
        if found:
            size = timedelta(hours=int(found[2]), minutes=int(found[3] or 0))
            offset = -size if "-" in found[1] else size
            after = after[found.end() :]
        # What follows the time but is no date is the name of a zone.
        after = re.sub(r"[^\W\d_]+", lambda m: m[0] if _month(m[0]) and m[0].upper() not in ZONES else " ", after)
        rest = t[: time.start()] + " " + after
    american = bool(time and (time[4] or (time[3] and re.search(r"[A-Z]{3}$", t)) or re.match(r"[A-Za-z]{3}, \d\d/\d\d/\d{4} - ", t) or re.match(r"\d\d/\d\d/\d\d \d\d:", t))) or bool(re.match(r"[A-Za-z]{3}, \d\d \d\d \d{4} ", t))
    try:
        year, month, day = _day(rest, american)
        at = datetime(year, month, day, hour, minute, second)
    except (ValueError, IndexError) as e:
        raise ValueError(f"not a date: {text}") from e
    return (at - offset).replace(tzinfo=timezone.utc)


@pandas_function("timestamp")
def parse_date_udf(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return pd.Timestamp(parse_date(t)).tz_localize(None) if t else pd.NaT
        except (ValueError, OverflowError):
            return pd.NaT

    return text.map(one).astype("datetime64[us]")


def parse_common(text: Column) -> Column:
    """ISO 8601, RFC 822 and unix seconds with Spark's own functions; null for anything else."""
    t = F.trim(text)
    rfc = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]+,\s*", ""), r"\s(GMT|UTC|UT|Z)$", " +0000")
    tries = [F.try_to_timestamp(rfc, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z")]
    seconds = F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("long")))
    return F.coalesce(seconds, t.try_cast("timestamp"), *tries)
