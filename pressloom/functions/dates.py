"""Publication dates: strict formats, patterns in text by their first match, and the waterfall over both. Built-in expressions.

Every result is an instant. What states no zone is local time at ZONE. A date counts
only from FIRST_YEAR on and up to two days after ``now``; each pattern is judged by
itself, so an impossible or invalid match gives way to the next pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "+05:30"
FIRST_YEAR = 2006
#: Characters of a body that are searched.
BODY = 3000

# Month names, English and Sinhala.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SINHALA_MONTHS = ["ජනවාරි", "පෙබරවාරි", "මාර්තු", "අප්‍රේල්", "මැයි", "ජූනි", "ජූලි", "අගෝස්තු", "සැප්තැම්බර්", "ඔක්තෝබර්", "නොවැම්බර්", "දෙසැම්බර්"]
# The shapes of dates in text, in the order in which they are tried.
_LONG = "|".join(MONTHS)
_ANY = "|".join(MONTHS + [m[:3] for m in MONTHS])
_CLOCK = r"(\d{1,2}):(\d{2})\s*"
PATTERNS = {
    "month_day_year_time": rf"(?i)\b({_LONG})\s+(\d{{1,2}}),?\s+(\d{{4}})\s+{_CLOCK}(am|pm)?",
    "month_day_year": rf"(?i)\b({_LONG})\s+(\d{{1,2}}),?\s+(\d{{4}})\b",
    "year_month_day": r"\b(\d{4})[-./](\d{2})[-./](\d{2})\b",
    "day_month_year_time": rf"(?i)\b(\d{{1,2}})\s+({_ANY})\s+(\d{{4}})\s+{_CLOCK}(am|pm)",
    "day_month_year": rf"(?i)\b(\d{{1,2}})\s+({_ANY})\s+(\d{{4}})\b",
    "day_month_year_numbers": r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b",
    "year_sinhala_day": rf"\b(\d{{4}})\s+({'|'.join(SINHALA_MONTHS)})\s+(\d{{1,2}})\b",
    "spaced_numbers": r"\b(\d{1,2})\s+(\d{2})\s+(\d{4})\b",
}
URL = r"/(\d{4})/(\d{2})/(\d{2})/"
# Hours of the zone names of mail dates.
MAIL_ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_ISO = r"(?i)^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:(?:T(\d{1,2}):(\d{1,2}):(\d{1,2})(\.\d{1,6})?| (\d{1,2}):(\d{1,2}):(\d{1,2}))(Z|[+-]\d{2}:?\d{2}))?\s*$"
_MAIL = rf"(?i)^\s*(?:[a-z]{{3,9}},?\s*)?(\d{{1,2}})\s+({'|'.join(m[:3] for m in MONTHS)})[a-z]*\s+(\d{{4}}|\d{{2}})\s+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?\s*([+-]\d{{4}}|{'|'.join(MAIL_ZONES)})?\s*$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _groups(text: Column, pattern: str, then: Callable[[Callable[[int], Column]], Column]) -> Column:
    """``then`` of the groups of the first match: found once, and then taken apart once, by itself."""
    glue = "\x1f".join(f"${k + 1}" for k in range(re.compile(pattern).groups))
    apart = lambda m: F.split(F.regexp_replace(m, F.lit(pattern), F.lit(glue)), "\x1f")
    given = lambda m: _let(apart(m), lambda a: then(lambda k: F.nullif(F.get(a, F.lit(k - 1)), F.lit(""))))
    return _let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", given(m)))


def _lookup(names: list[str], numbers: list, key: Column) -> Column:
    pairs = [F.lit(x) for pair in zip(names, numbers, strict=True) for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def month_number(name: Column) -> Column:
    """1 to 12 for a full or three-letter English month name."""
    return _lookup([m[:3] for m in MONTHS], list(range(1, 13)), F.lower(F.substring(name, 1, 3)))


def _instant(now: str, year: Column, month: Column, day: Column, hour=None, minute=None, second=None, zone: Column | None = None) -> Column:
    """The valid instant of these parts; null where one is impossible, or outside the window around ``now`` (UTC)."""
    number = lambda c: F.lit(0) if c is None else c.try_cast("int")
    seconds = (F.lit(0) if second is None else second).cast("decimal(16,6)")
    at = F.try_make_timestamp(number(year), number(month), number(day), number(hour), number(minute), seconds, F.lit(ZONE) if zone is None else zone)
    latest = F.lit(now + "+00:00").cast("timestamp") + F.expr("interval 2 days")
    return F.when((number(year) >= FIRST_YEAR) & (at <= latest), at)


def _clock(hour: Column, half: Column) -> Column:
    """The hour of a day from a twelve-hour clock; null for other hours than 1 to 12."""
    h = hour.try_cast("int")
    return F.when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "pm", 12).when(F.lower(half) == "am", 0))


def shapes(text: Column, now: str) -> dict[str, Column]:
    """The valid instant that each pattern's first match states, or null."""
    sinhala = lambda name: _lookup(SINHALA_MONTHS, list(range(1, 13)), name)
    parts = {
        "month_day_year_time": lambda g: _instant(now, g(3), month_number(g(1)), g(2), F.coalesce(_clock(g(4), g(6)), F.lit(99)), g(5)),
        "month_day_year": lambda g: _instant(now, g(3), month_number(g(1)), g(2)),
        "year_month_day": lambda g: _instant(now, g(1), g(2), g(3)),
        "day_month_year_time": lambda g: _instant(now, g(3), month_number(g(2)), g(1), F.coalesce(_clock(g(4), g(6)), F.lit(99)), g(5)),
        "day_month_year": lambda g: _instant(now, g(3), month_number(g(2)), g(1)),
        "day_month_year_numbers": lambda g: _instant(now, g(3), g(2), g(1)),
        "year_sinhala_day": lambda g: _instant(now, g(1), sinhala(g(2)), g(3)),
        "spaced_numbers": lambda g: _instant(now, g(3), g(2), g(1)),
    }
    return {name: _groups(text, PATTERNS[name], parts[name]) for name in PATTERNS}


def _dated(text: Column) -> Column:
    """The part of a text in which a pattern can match: from the word and blanks before its first digit on; null without digits.

    A match begins with a digit, or with a month's name and blanks before the first. What decides
    whether a word begins there is kept, too: marks and the character that they stand on.
    """
    before = lambda at: F.reverse(F.regexp_extract(F.reverse(text.substr(F.lit(1), at - 1)), r"(?s)^\s*[A-Za-z]{0,9}\p{M}*.?", 0))
    return _let(F.regexp_instr(text, F.lit("([0-9])")), lambda at: F.when(at > 0, F.concat(before(at), text.substr(at, F.length(text)))))


def from_text(text: Column, now: str) -> Column:
    """The first pattern's valid instant."""
    return _let(text, lambda whole: _let(_dated(whole), lambda said: F.when(said.isNotNull(), F.coalesce(*shapes(said, now).values()))))


def from_url(url: Column, now: str) -> Column:
    """The day in a path /YYYY/MM/DD/."""
    return _groups(url, URL, lambda g: _instant(now, g(1), g(2), g(3)))


def strict(text: Column, now: str) -> Column:
    """A whole string in ISO form, a time only with its zone, or in the form of mail headers; without a zone it is local."""

    def offset(zone: Column) -> Column:
        digits = F.regexp_replace(zone, "[^0-9]", "")
        return F.when(F.upper(zone) == "Z", "+00:00").when(
            F.substring(digits, 1, 2).cast("int") < 18, F.concat(F.substring(zone, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))
        )

    def iso(g) -> Column:
        seconds = F.concat(F.coalesce(g(6), g(10), F.lit("0")), F.coalesce(g(7), F.lit("")))
        zone = F.when(g(11).isNull(), ZONE).otherwise(offset(g(11)))
        return _instant(now, g(1), g(2), g(3), F.coalesce(g(4), g(8), F.lit("0")), F.coalesce(g(5), g(9), F.lit("0")), seconds, zone)

    def mail(g) -> Column:
        year = g(3).cast("int")
        full = F.when(F.length(g(3)) == 4, year).when(year <= 68, year + 2000).otherwise(year + 1900)
        hours = _lookup(list(MAIL_ZONES), [f"{h:+03d}:00" for h in MAIL_ZONES.values()], F.upper(g(7)))
        zone = F.when(g(7).isNull() | (g(7) == "-0000"), ZONE).when(g(7).rlike("^[+-]"), offset(g(7))).otherwise(hours)
        return _instant(now, full, month_number(g(2)), g(1), g(4), g(5), F.coalesce(g(6), F.lit("0")), zone)

    return F.coalesce(_groups(text, _ISO, iso), _groups(text, _MAIL, mail))


def waterfall(meta: Column | None, selector: Column | None, url: Column | None, body: Column | None, feed: Column | None, now: str) -> Column:
    """The first valid instant of: the meta text read strictly, the selected text's patterns, the URL, the body's first BODY characters, the feed's date read strictly; a level that is None is left out."""
    levels = [(meta, strict), (selector, from_text), (url, from_url), (None if body is None else F.substring(body, 1, BODY), from_text), (feed, strict)]
    return F.coalesce(*(read(said, now) for said, read in levels if said is not None))


def month_range(month: Column) -> Column:
    """struct(first, last) days of a month given as YYYY-MM; null parts for other strings."""
    first = F.when(month.rlike(r"^\d{4}-\d{2}$"), F.concat(month, F.lit("-01")).try_cast("date"))
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def local_day(at: Column) -> Column:
    """The day of an instant at ZONE."""
    hours, minutes = map(int, ZONE[1:].split(":"))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.unix_seconds(at) + hours * 3600 + minutes * 60) / 86400).cast("int"))


def ago(seconds: Column) -> Column:
    """5m ago, 3h ago or 2d ago, rounded, for seconds past; - for null."""
    said = lambda unit, name: F.concat(F.floor(seconds / unit + 0.5).cast("string"), F.lit(f"{name} ago"))
    return F.when(seconds.isNull(), "-").when(seconds < 3600, said(60, "m")).when(seconds < 86400, said(3600, "h")).otherwise(said(86400, "d"))


def duration(seconds: Column) -> Column:
    """45s or 3m, rounded; - for null."""
    said = lambda unit, name: F.concat(F.floor(seconds / unit + 0.5).cast("string"), F.lit(name))
    return F.when(seconds.isNull(), "-").when(seconds < 60, said(1, "s")).otherwise(said(60, "m"))


def day_label(day: Column, today: Column) -> Column:
    """Today, Yesterday, or the day as in Wed, Feb 4."""
    back = F.datediff(today, day)
    return F.when(back == 0, "Today").when(back == 1, "Yesterday").otherwise(F.date_format(day, "EEE, MMM d"))
