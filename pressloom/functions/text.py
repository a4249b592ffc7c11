"""Text columns: titles, languages, excerpts, links and display forms. Built-in expressions, but for Unicode composition."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
SAMPLE = 500
# Frequent Sinhala words, and how many first words of a text are looked at.
SINHALA = ["සහ", "හා", "ඇති", "කළ", "බව", "මෙම", "ඒ", "අද", "එම", "නව"]
FIRST_WORDS = 50


# Double-encoded punctuation and what it stands for.
MOJIBAKE = {"Ã¢â\u201aÂ¬â\u201e¢": "\u2019", "Ã¢â\u201aÂ¬â\u20ac\u201d": "\u2014", "Ã¢â\u201aÂ¬Â¦": "\u2026"}


def collapse_spaces(text: Column) -> Column:
    """Runs of any Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, F.lit(SPACES), F.lit(" ")))


def composed(text: Column) -> Column:
    """A text in Unicode's composed form (NFC); only texts with a character beyond ASCII reach Python."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(F.arrow_udf(run, "string")(F.when(text.rlike(r"[^\x{00}-\x{7F}]"), text)), text)


def normalized(text: Column) -> Column:
    """A text composed (NFC), its HTML entities resolved once, double-encoded punctuation mended, white space collapsed."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(unicodedata.normalize("NFC", t)) for t in texts.to_pylist()], pa.string())

    out = F.arrow_udf(run, "string")(text)
    for bad, good in MOJIBAKE.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return collapse_spaces(out)


def title_key(title: Column) -> Column:
    """Letters, digits, underscores and joiners of a composed (NFC) title, in lower case."""
    return F.regexp_replace(F.lower(composed(title)), F.lit(r"[^\p{L}\p{N}_\x{200C}\x{200D}]"), F.lit(""))


def detect_language(text: Column) -> Column:
    """si where over a tenth of the first 500 characters are Sinhala, or one of the first 50 words of the whole text is in SINHALA, else en; null and empty give en."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)
    share = F.length(F.regexp_replace(sample, F.lit(r"[^\x{0D80}-\x{0DFF}]"), F.lit(""))) / F.length(sample)
    # one match at the start of the text, which is not copied
    some = SPACES.removesuffix("+")
    leading = F.regexp_extract(text, f"^{some}*+((?:{some.replace('[', '[^', 1)}++{some}*+){{0,{FIRST_WORDS}}})", 1)
    first = F.split(leading, SPACES)
    return F.when(F.length(sample) == 0, "en").when((share > 0.1) | F.arrays_overlap(first, F.array(*map(F.lit, SINHALA))), "si").otherwise("en")


# How lines begin that are no excerpt, bylines, credits and datelines.
EXCERPT_SKIP = r"(?i)^(By\s+[A-Z]|Photo\s*:|Pic\s*:|Image\s*:|Courtesy\s*:|Colombo,?\s|COLOMBO\s*\(|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*\d)"
BYLINE = r"^By\s+([A-Za-z][A-Za-z. ]+?)(?=\s+Colombo|\s+[A-Z]{2,})"
DATELINES = [
    r"(?i)^Colombo,?\s+.{0,60}?\((?:Daily\s?Mirror|DailyMirror|Mirror\s+Sports)\)\s*-?\s*",
    r"(?i)^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*\d{1,2}(?:st|nd|rd|th)?(?:\s*\((?:Daily\s?Mirror|DailyMirror|Mirror\s+Sports)\))?\s*-\s*",
    r"(?i)^COLOMBO\s*\(News\s?1st\)\s*[;:–-]\s*",
    r"^ECONOMYNEXT\s*[–—-]\s*",
]


def clean_author(author: Column) -> Column:
    """An author without a leading By and a trailing date; null where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(author, r"^[Bb]y\s+", ""), r"(?s)\s*\d{1,2}[-/]\d{1,2}[-/]\d{4}.*$", "")
    return F.nullif(F.trim(out), F.lit(""))


def byline(content: Column) -> Column:
    """The author that a content begins with, or null."""
    return F.nullif(F.trim(F.regexp_extract(content, BYLINE, 1)), F.lit(""))


def without_byline(content: Column) -> Column:
    """A content without the byline and, each once and in order, the datelines at its beginning."""
    out = F.regexp_replace(content, BYLINE, "")
    for pattern in DATELINES:
        out = F.regexp_replace(out, pattern, "")
    return out


def fallback_hue(slug: Column) -> Column:
    """0 to 359 from a name's characters, by a rolling hash in 32-bit arithmetic."""
    chars = F.filter(F.split(slug, ""), lambda c: c != "")
    shifted = lambda h: F.pmod(h * 32 + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return F.abs(F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.ascii(c).cast("long") + shifted(h) - h)) % 360


def fenced_json(answer: Column) -> Column:
    """What a model's answer holds between code fences, the JSON fence first; the whole answer without any."""
    between = lambda fence: F.substring_index(F.substring(answer, F.instr(answer, fence) + len(fence), F.length(answer)), "```", 1)
    return F.trim(F.when(F.contains(answer, F.lit("```json")), between("```json")).when(F.contains(answer, F.lit("```")), between("```")).otherwise(answer))


def image_of(description: Column) -> Column:
    """The first image address in an item's HTML description, or null."""
    return F.nullif(F.regexp_extract(description, r"(?i)src=['\"](https?://[^'\"]+)['\"]", 1), F.lit(""))


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^?#]*\?([^#]*)", 1)


def badge(score: Column) -> Column:
    """green from 7, yellow from 4, else red; null without a score."""
    return F.when(score >= 7, "green").when(score >= 4, "yellow").when(score.isNotNull(), "red")


def first_of(items: Column, k: int) -> Column:
    """The first ``k`` names and how many more there are: a, b, c +2 more."""
    more = F.size(items) - k
    return F.concat(F.array_join(F.slice(items, 1, k), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def trimmed_lines(content: Column) -> Column:
    """A text's lines without blanks at their ends."""
    return F.transform(F.split(content, "\n"), lambda x: F.trim(x))  # F.trim itself would be given the line's number as what to trim


def excerpt(content: Column) -> Column:
    """The first line of 40 or more characters that is no heading, image, rule, byline, credit or dateline, else the content: 300 characters of it."""
    fits = lambda x: (F.length(x) >= 40) & ~x.rlike(r"^(#|!\[|---)") & ~x.rlike(EXCERPT_SKIP)
    lines = F.filter(trimmed_lines(content), fits)
    return F.substring(F.coalesce(F.get(lines, 0), content), 1, 300)


def format_number(n: Column) -> Column:
    """1234 as 1.2K and 3400000 as 3.4M; smaller numbers as they are."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n >= 1_000_000, F.concat(one(n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(one(n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def truncated(text: Column, length: int) -> Column:
    """A text over ``length`` characters cut to it, without white space at the cut, and three dots."""
    cut = F.regexp_replace(F.substring(text, 1, length), F.lit(SPACES + "$"), F.lit(""))
    return F.when(F.length(text) > length, F.concat(cut, F.lit("..."))).otherwise(text)


def citations(answer: Column, n_sources: Column) -> Column:
    """The numbers of the citation marks [n] of an answer that name one of its sources, in order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
    return F.filter(found, lambda x: (x >= 1) & (x <= n_sources))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def error_class(status: Column, length: Column, challenged: Column | None = None, failure: Column | None = None) -> Column:
    """404 and 5xx as their code, an unresolved challenge as cloudflare, texts under 100 characters as empty, else null.

    failure: the name of what broke the fetch, if anything did: TimeoutError is timeout, any other unknown.
    """
    broke = F.lit(None).cast("string") if failure is None else failure
    gate = F.lit(False) if challenged is None else F.coalesce(challenged, F.lit(False))
    found = F.when(broke == "TimeoutError", "timeout").when(broke.isNotNull(), "unknown").when(status == 404, "404").when(status >= 500, status.cast("string"))
    return found.when(gate, "cloudflare").when(F.coalesce(length, F.lit(0)) < 100, "empty")
