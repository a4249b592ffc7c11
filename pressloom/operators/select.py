"""Selections of the store: optional predicates, day ranges, samples, skip and allow lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a url to skip holds, in any case of letters.
SKIPPED_URLS = r"(?i)(\.(jpg|jpeg|png|gif|svg|webp|pdf)$|/feed/?$|/print/?$|/wp-content/uploads/|/(category|tag|author|page)/|/(hot-news|news_archive|sports|entertainment-news)/?$|/\?mode=(beauti|head))"


def stamp_of(at: str) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def on_day(column: str, day: str) -> Column:
    """Whether a time is on a day, as a half-open range that reaches the scan."""
    at = F.col(column)
    return (at >= stamp_of(day)) & (at < stamp_of(day) + F.expr("interval 1 day"))


def since_months(column: str, now: str, months: int) -> Column:
    """From the first of the month ``months`` - 1 before that of ``now`` on, without an upper bound."""
    return F.col(column) >= F.add_months(F.trunc(F.lit(now).cast("date"), "month"), 1 - months).cast("timestamp_ntz")


def valid_day(day: Column) -> Column:
    """Whether a text is a day of the calendar as YYYY-MM-DD; null is none."""
    return F.coalesce(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date")).isNotNull(), F.lit(False))


def where_given(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every predicate given: {column: value}, {column__since: time}, {column__until: time}, {column__day: day}, {column__in: list}, {column__null: bool}; None asks nothing."""
    of = {
        "": lambda c, v: F.col(c) == v,
        "since": lambda c, v: F.col(c) >= stamp_of(v),
        "until": lambda c, v: F.col(c) < stamp_of(v),
        "day": on_day,
        "in": lambda c, v: F.col(c).isin(list(v)),
        "null": lambda c, v: F.col(c).isNull() if v else F.col(c).isNotNull(),
    }
    parts = [of[kind](column, value) for name, value in wanted.items() if value is not None for column, _, kind in [name.partition("__")]]
    return rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows


def sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in the seeded order of MD5(seed|key): a sample that repeats itself. A top-k of narrow keys, met by their rows."""
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(place, key).limit(n)


def skipped(url: Column) -> Column:
    """Whether a url is an image, a feed, a print view, an upload, a list or such; null urls are not."""
    return F.coalesce(url.rlike(SKIPPED_URLS), F.lit(False))


def path_and_query(url: Column) -> Column:
    """The path and query part of a url; / for a bare host."""
    rest = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def allowed(urls: DataFrame, patterns: DataFrame, key: str = "slug") -> DataFrame:
    """Rows whose url's path and query match a pattern of their source in patterns(key, allow, skip), and none of its skip patterns.

    A source without allow patterns allows all. patterns has one row a source, arrays
    of regular expressions, joined as one alternation each.
    """
    some = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.array_join(c, "|"))
    met = urls.join(F.broadcast(patterns.select(key, some(F.col("allow")).alias("_allow"), some(F.col("skip")).alias("_skip"))), key, "left")  # one row a source
    path = path_and_query(F.col("url"))
    fits = F.coalesce(F.regexp_like(path, F.col("_allow")), F.lit(True)) & ~F.coalesce(F.regexp_like(path, F.col("_skip")), F.lit(False))
    return met.where(fits).drop("_allow", "_skip")


def or_else(*choices: Column | str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in choices))


def split_valid(rows: DataFrame, **rules: Column) -> DataFrame:
    """``rows`` with ``broken``, the names of the rules that a row does not meet (a null counts as not met): empty for valid rows."""
    return rows.withColumn("broken", F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))))
