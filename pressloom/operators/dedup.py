"""Candidates against what is known: by url, by title, and among themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pressloom.functions.text import title_key
from pressloom.session import checkpointed

OUTCOMES = ("dead_link", "failed", "skipped_no_date", "skipped_duplicate", "inserted")
#: Titles of so few key characters never block another.
SHORT_TITLE = 10


def unknown(candidates: DataFrame, known: DataFrame, dead: DataFrame) -> DataFrame:
    """Candidates whose url is neither in known(url) nor dead(url)."""
    return candidates.join(known.select("url").unionByName(dead.select("url")), "url", "left_anti")


def first_seen(items: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: a combining aggregate, so no key is gathered."""
    rest = [c for c in items.columns if c not in {*key, *order}]
    best = items.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return best.select(*(F.col(c) if c in key else F.col("first")[c].alias(c) for c in items.columns))


def first_titles(items: DataFrame) -> DataFrame:
    """items(slug, title, id, ...) without later rows of a source whose title has the same key; short titles all pass.

    Later is by id, null ids last. A null source is a source like any other. One scan, one
    key a title, one combining aggregate: a short title is grouped with nothing but
    rows equal to it, which come out again as often as they were.
    """
    keyed = items.withColumn("_key", title_key(F.coalesce("title", F.lit(""))))
    rest = [c for c in items.columns if c not in ("slug", "id")]
    row = F.struct(F.col("id").isNull().alias("_none"), "id", *rest)
    alone = F.when(F.length("_key") <= SHORT_TITLE, row)
    firsts = keyed.groupBy("slug", "_key", alone.alias("_alone")).agg(F.min(row).alias("_first"), F.count(alone).alias("_n"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("_n"))))
    return firsts.select("slug", "_first", again).select(*(F.col("slug") if c == "slug" else F.col("_first")[c].alias(c) for c in items.columns))


def without_known_titles(items: DataFrame, recent: DataFrame) -> DataFrame:
    """items whose (source, title key) is not among recent(slug, title)'s; short titles all pass."""
    key = title_key(F.coalesce("title", F.lit("")))
    seen = recent.select("slug", key.alias("_key")).where(F.length("_key") > SHORT_TITLE).distinct()
    return items.withColumn("_key", key).join(seen, ["slug", "_key"], "left_anti").select(*items.columns)


def without_known_titles_since(items: DataFrame, store: DataFrame, since: str, at: str = "created_at") -> DataFrame:
    """The same against the store's titles of a window: those with ``at`` at or after ``since``."""
    return without_known_titles(items, store.where(F.col(at) >= F.lit(since).cast("timestamp_ntz")))


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with the same key; one row a key in ``changes``."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the columns of ``changes`` where its key is among theirs, nulls too; unknown keys change nothing, one row a key in ``changes``."""
    columns = [c for c in changes.columns if c != key]
    met = changes.select(key, F.struct(*columns).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    return table.join(met, key, "left").select(*(value(c) if c in columns else F.col(c) for c in table.columns))


def inserted(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``table`` and the first of the rows of each key that it lacks, by ``order``; what is there stays, rows without a key go."""
    fresh = first_seen(rows.where(F.col(key).isNotNull()), [key], order)
    return table.unionByName(fresh.join(table.select(key), key, "left_anti").select(*table.columns))


def remapped(rows: DataFrame, own: DataFrame, other: DataFrame, key: str, through: str) -> DataFrame:
    """``rows`` with the ``key`` that the other store gives to the same ``through``; rows of names it lacks go.

    own(key, through) and other(key, through) are dimensions. Count what goes by an anti join with this map.
    """
    names = own.select(F.col(key).alias("_own"), through).join(other.select(F.col(key).alias("_other"), through), through).select("_own", "_other")
    return rows.join(names, F.col(key) == F.col("_own")).withColumn(key, F.col("_other")).select(*rows.columns)


def synced(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """What either store has, by ``key``, after the other's missing rows came in: its own row stays."""
    return own.unionByName(other.join(own.select(key), key, "left_anti").select(*own.columns))


def outcomes(attempts: DataFrame, known: DataFrame, least: int = 100, tally: Observation | None = None) -> DataFrame:
    """``attempts`` with an ``outcome`` each: dead_link, failed, skipped_no_date, skipped_duplicate or inserted.

    attempts(slug, url, title, content, error, published_at, seq): one row a fetched
    item, in the order ``seq``. known(slug, url, title) is the store within its window.
    An error makes a dead link; a text under ``least`` characters fails; no date, then a
    known url or title, then a title or url that an earlier inserted item of the run has, skip it.

    Attempts are read once, to narrow rows that are written, and so is the store. ``tally`` observes, in the
    pass that gives the outcomes out, how many of each there are and those without a date.
    """
    read = attempts.withColumn("_key", title_key(F.coalesce("title", F.lit(""))))
    stage = F.when(F.col("error").isNotNull(), "dead_link").when(F.length(F.coalesce("content", F.lit(""))) < least, "failed").when(F.col("published_at").isNull(), "skipped_no_date")
    columns = [c for c in attempts.columns if c not in ("title", "content", "error")]
    narrow = read.withColumn("_stage", stage).select(*columns, "_key", "_stage")
    key = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), *(p.alias(n) for p, n in zip(parts, ("a", "b"), strict=True)))
    url_key, title_as_key = key("url", F.lit(""), F.col("url")), key("title", F.coalesce("slug", F.lit("")), F.col("_key"))
    long = (F.length("_key") > SHORT_TITLE) & F.col("slug").isNotNull()
    stored = known.select("slug", "url", title_key(F.coalesce("title", F.lit(""))).alias("_key"))
    stored = stored.select(F.explode(F.array(F.when(F.col("url").isNotNull(), url_key), F.when(long, title_as_key))).alias("_k")).where("_k is not null").distinct()
    asked = narrow.select("seq", "_stage", F.explode(F.array(F.when(F.col("url").isNotNull(), url_key), F.when(long, title_as_key))).alias("_k"))
    held = asked.where("_stage is null and _k is not null").join(stored, "_k", "left_semi").select("seq").distinct().withColumn("_held", F.lit(True))
    met = checkpointed(narrow.join(held, "seq", "left").withColumn("_stage", F.coalesce("_stage", F.when(F.col("_held"), "skipped_duplicate"))).drop("_held"))
    # an item whose url is taken was not inserted, so its title blocks nobody: urls are settled first
    by_url = met.where("_stage is null").groupBy("url").agg(F.min("seq").alias("_first_url"))
    by_title = met.where("_stage is null").join(by_url, "url").where("seq = _first_url").where(F.length("_key") > SHORT_TITLE).groupBy("slug", "_key").agg(F.min("seq").alias("_first_title"))
    late = (F.col("seq") > F.col("_first_url")) | (F.col("seq") > F.coalesce("_first_title", F.col("seq")))
    settled = met.join(by_url, "url", "left").join(by_title, ["slug", "_key"], "left")
    found = settled.withColumn("outcome", F.coalesce("_stage", F.when(late, "skipped_duplicate"), F.lit("inserted"))).select(*columns, "outcome")
    if tally is None:
        return found
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
    return found.observe(tally, F.count("*").alias("attempts"), F.count(F.when(F.col("published_at").isNull(), 1)).alias("without_date"), *counts)
