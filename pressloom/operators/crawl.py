"""Crawl plans: which pages, numbers and days to fetch, and where a crawl ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import dates, text
from pressloom.operators.links import sweep_end

#: Numbers that are fetched together.
BATCH = 50
#: Pages in a row without a new link that end a section.
MOST_EMPTY = 3
# The first year that a feed's item counts.
FEED_YEAR = 2025


def archive_pages(sections: DataFrame, max_pages: int) -> DataFrame:
    """(slug, section, i, url) of sections(slug, section, pattern, page_start, page_step, pages): the archive's pages, ``max_pages`` of a section at most."""
    i = F.explode(F.sequence(F.lit(0), F.least(F.col("pages"), F.lit(max_pages)) - 1))
    some = sections.where((F.col("pages") > 0) & (F.lit(max_pages) > 0)).select("*", i.alias("i"))
    return some.select("slug", "section", "i", F.replace("pattern", F.lit("{page}"), (F.col("page_start") + F.col("i") * F.col("page_step")).cast("string")).alias("url"))


def section_end(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, stop): the page that ends a section, the first without links or the third in a row without new ones; null if none does.

    pages(key, i, links, new): numbers of links and of new links by page.
    """
    one = pages.withColumn("_key", F.struct(*key))
    empty = one.where("links = 0").groupBy("_key").agg(F.min("i").alias("_empty"))
    stale = sweep_end(one.select("_key", "i", "new"), MOST_EMPTY, "_key", "i", F.col("new") > 0)
    return stale.join(empty, "_key", "left").select("_key.*", F.least("stop", "_empty").alias("stop"))


def visited(pages: DataFrame, key: list[str]) -> DataFrame:
    """The pages that a crawl fetches: those up to the page that ends their section."""
    ends = section_end(pages, key)
    return pages.join(ends, key).where(F.col("stop").isNull() | (F.col("i") <= F.col("stop"))).drop("stop")


def number_plan(spark, start: int, end: int, template: str, reverse: bool = False) -> DataFrame:
    """(batch, place, nid, url): the numbers of a range in fetch order, BATCH to a batch."""
    ids = spark.range(start, end + 1).select(F.col("id").alias("nid"))
    place = (F.lit(end) - F.col("nid") if reverse else F.col("nid") - F.lit(start)).alias("place")
    return ids.select("nid", place).select(F.floor(F.col("place") / BATCH).alias("batch"), "place", "nid", F.replace(F.lit(template), F.lit("{nid}"), F.col("nid").cast("string")).alias("url"))


def day_plan(spark, start: str, today: str, days: int, template: str, form: str) -> DataFrame:
    """(day, url): the days from ``start``, or ``days`` ago if that is later, to ``today``; ``form`` is a date pattern for {date}."""
    first = F.greatest(F.lit(start).cast("date"), F.date_sub(F.lit(today).cast("date"), days))
    every = spark.range(1).where(first <= F.lit(today).cast("date")).select(F.explode(F.sequence(first, F.lit(today).cast("date"))).alias("day"))
    return every.select("day", F.replace(F.lit(template), F.lit("{date}"), F.date_format("day", form)).alias("url"))


def or_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The items of ``first``, and those of ``second`` of the keys that ``first`` has none of."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def methods(config: DataFrame) -> DataFrame:
    """``config(declared array, archive, numbers, days)`` with ``methods``: what is declared, else archive, nid_sweep and date_sweep by what there is."""
    found = F.array_compact(F.array(*(F.when(F.col(c), F.lit(m)) for c, m in (("archive", "archive"), ("numbers", "nid_sweep"), ("days", "date_sweep")))))
    return config.withColumn("methods", F.coalesce("declared", found))


def streaks(days: DataFrame, key: str, day: str, hit: Column) -> DataFrame:
    """(key, first, days): the runs of days without a hit, by islands between hits."""
    island = F.sum(hit.cast("int")).over(Window.partitionBy(key).orderBy(day))
    return days.withColumn("_island", island).where(~hit).groupBy(key, "_island").agg(F.min(day).alias("first"), F.count("*").alias("days")).drop("_island")


def feed_items(entries: DataFrame) -> DataFrame:
    """(title, link, pub_date, description, image_url) of a feed's entries(title, link, id, published, updated, summary).

    Entries without a link or id go, and those dated before FEED_YEAR; a date that cannot be read counts as recent.
    """
    link = F.coalesce(F.nullif("link", F.lit("")), F.nullif("id", F.lit("")))
    date = F.coalesce(F.nullif("published", F.lit("")), F.nullif("updated", F.lit("")))
    year = F.year(dates.local_day(dates.strict(date, "9000-01-01 00:00:00")))
    old = F.when(date.rlike(r"\d\d:\d\d"), year < FEED_YEAR)
    some = entries.where(link.isNotNull() & ~F.coalesce(old, F.lit(False)))
    return some.select(F.coalesce("title", F.lit("Untitled")).alias("title"), link.alias("link"), date.alias("pub_date"), F.col("summary").alias("description"), text.image_of(F.col("summary")).alias("image_url"))


def read_feed(spark, path: str) -> DataFrame:
    """The items of RSS files, by Spark's XML source."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string").load(path)
    return feed_items(raw.select("title", "link", F.col("guid").alias("id"), F.col("pubDate").alias("published"), F.lit(None).cast("string").alias("updated"), F.col("description").alias("summary")))
