"""Queries on crawl plans and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.operators import crawl, links, ranks
from pressloom.plans.registry import query
from pressloom.session import load
from pressloom.sources.adapter import ARTICLES_SQL, articles


@query("archive_urls", "SELECT n_name AS slug, n_regionkey AS section, i, 'https://a.example/' || n_nationkey || '?page=' || (1 + i * (1 + n_regionkey)) AS url FROM nation, (SELECT unnest(range(0, 5)) AS i) WHERE i < n_nationkey % 9")
def archive_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("n_nationkey")
    pattern = F.concat(F.lit("https://a.example/"), number.cast("string"), F.lit("?page={page}"))
    sections = load(spark, sf_dir, "nation").select(F.col("n_name").alias("slug"), F.col("n_regionkey").alias("section"), pattern.alias("pattern"), F.lit(1).alias("page_start"), (1 + F.col("n_regionkey")).alias("page_step"), (number % 9).cast("int").alias("pages"))
    return crawl.archive_pages(sections, 5).withColumn("i", F.col("i").cast("long"))


PAGES_SQL = "p AS (SELECT user_id AS slug, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_id % 41 = 0 THEN 0 ELSE 5 END AS links, CASE WHEN event_type IN ('purchase', 'view') AND event_id % 41 > 0 THEN 2 ELSE 0 END AS new FROM events)"


@query(
    "archive_visits",
    f"""WITH {PAGES_SQL}, n AS (SELECT *, sum((new > 0)::INT) OVER (PARTITION BY slug ORDER BY i) AS island FROM p), m AS (SELECT slug, i, row_number() OVER (PARTITION BY slug, island ORDER BY i) AS miss FROM n WHERE new = 0),
s AS (SELECT slug, min(i) AS stop FROM (SELECT slug, i FROM m WHERE miss = 3 UNION ALL SELECT slug, i FROM p WHERE links = 0) GROUP BY slug)
SELECT slug, count(*) AS pages, CAST(sum(new) AS BIGINT) AS found FROM p LEFT JOIN s USING (slug) WHERE stop IS NULL OR i <= stop GROUP BY slug""",
)
def archive_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched of each source's archive until one has no links or three in a row nothing new."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    none = F.col("event_id") % 41 == 0
    fresh = F.when(F.col("event_type").isin("purchase", "view") & ~none, 2).otherwise(0)
    pages = load(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), F.row_number().over(order).alias("i"), F.when(none, 0).otherwise(5).alias("links"), fresh.alias("new"))
    return crawl.visited(pages, ["slug"]).groupBy("slug").agg(F.count("*").alias("pages"), F.sum("new").alias("found"))


@query(
    "nid_sweep",
    """WITH o AS (SELECT o_orderkey % 9 AS sweep, o_orderkey AS nid, o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' AS missed FROM orders WHERE o_orderkey % 4 > 0),
i AS (SELECT *, sum((NOT missed)::INT) OVER (PARTITION BY sweep ORDER BY nid) AS island FROM o), m AS (SELECT sweep, nid, row_number() OVER (PARTITION BY sweep, island ORDER BY nid) AS miss FROM i WHERE missed),
s AS (SELECT sweep, min(nid) AS stop FROM m WHERE miss = 6 GROUP BY sweep) SELECT sweep, any_value(stop) AS stop, count(*) AS fetched FROM o LEFT JOIN s USING (sweep) WHERE stop IS NULL OR nid <= stop GROUP BY sweep""",
)
def nid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number sweeps that end after six misses in a row; known numbers (a quarter) neither count nor reset."""
    orders = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).alias("sweep"), F.col("o_orderkey").alias("nid"), "o_orderpriority")
    tried = orders.join(orders.where("nid % 4 = 0").select("nid"), "nid", "left_anti").withColumn("hit", F.col("o_orderpriority").rlike("^[12]"))
    ends = links.sweep_end(tried, 6, "sweep", "nid", F.col("hit"))
    return tried.join(ends, "sweep").where("stop is null or nid <= stop").groupBy("sweep").agg(F.first("stop").alias("stop"), F.count("*").alias("fetched"))


@query("nid_batches", "WITH r AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders), n AS (SELECT unnest(range(a, b + 1)) AS nid, b FROM r) SELECT (b - nid) // 50 AS batch, count(*) AS n, min(nid) AS first, max('https://n.example/' || nid) AS url FROM n GROUP BY 1")
def nid_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of all orders' numbers backwards, fifty to a batch."""
    first, last = load(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    every = crawl.number_plan(spark, first, last, "https://n.example/{nid}", reverse=True)
    return every.groupBy("batch").agg(F.count("*").alias("n"), F.min("nid").alias("first"), F.max("url").alias("url"))


@query("calendar_pages", "WITH r AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders) SELECT strftime(d, '%Y-%m-%d') AS day, 'https://c.example/' || strftime(d, '%Y/%m/%d') || '/' AS url FROM (SELECT unnest(generate_series(greatest(a, b - 90), b, INTERVAL 1 DAY)) AS d FROM r)")
def calendar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the last ninety days of the orders, or of all if they are fewer."""
    first, last = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).agg(F.min("d"), F.max("d")).first()
    found = crawl.day_plan(spark, str(first), str(last), 90, "https://c.example/{date}/", "yyyy/MM/dd")
    return found.select(F.col("day").cast("string").alias("day"), "url")


@query("discovery", f"WITH {ARTICLES_SQL}, f AS (SELECT slug, id FROM articles WHERE slug LIKE '%2') SELECT slug, id, 'feed' AS origin FROM f UNION ALL SELECT slug, id, 'listing' FROM articles WHERE id % 2 = 0 AND slug NOT IN (SELECT slug FROM f)")
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's feed, or its listing page where the feed has nothing."""
    rows = articles(spark, sf_dir).where("slug is not null").select("slug", "id")
    return crawl.or_fallback(rows.where("slug like '%2'").withColumn("origin", F.lit("feed")), rows.where("id % 2 = 0").withColumn("origin", F.lit("listing")), "slug")


@query("backfill_methods", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN 'nid_sweep' ELSE array_to_string(list_filter([CASE WHEN n_nationkey % 2 = 1 THEN 'archive' END, CASE WHEN n_nationkey % 3 = 1 THEN 'nid_sweep' END, CASE WHEN n_nationkey % 5 = 1 THEN 'date_sweep' END], lambda x: x IS NOT NULL), ',') END AS methods FROM nation")
def backfill_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    config = load(spark, sf_dir, "nation").select(n.alias("id"), F.when(n % 6 == 0, F.array(F.lit("nid_sweep"))).alias("declared"), (n % 2 == 1).alias("archive"), (n % 3 == 1).alias("numbers"), (n % 5 == 1).alias("days"))
    return crawl.methods(config).select("id", F.array_join("methods", ",").alias("methods"))


@query(
    "empty_days",
    f"""WITH {ARTICLES_SQL}, d AS (SELECT s.slug, d.day, count(a.id) > 0 AS hit FROM (SELECT DISTINCT slug FROM articles WHERE slug IS NOT NULL) s CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-20', INTERVAL 1 DAY)) AS DATE) AS day) d
  LEFT JOIN articles a ON a.slug = s.slug AND CAST(a.published_at AS DATE) = d.day AND a.id % 3 = 0 GROUP BY s.slug, d.day), i AS (SELECT *, sum(hit::INT) OVER (PARTITION BY slug ORDER BY day) AS island FROM d)
SELECT slug, strftime(min(day), '%Y-%m-%d') AS first, count(*) AS days FROM i WHERE NOT hit GROUP BY slug, island""",
)
def empty_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days on which a third of the articles leaves a source empty."""
    from pressloom.operators import stats
    from pressloom.sources.adapter import sources

    grid = stats.coverage(sources(spark, sf_dir), articles(spark, sf_dir).where("id % 3 = 0"), "2024-01-01", "2024-02-20")
    return crawl.streaks(grid, "slug", "day", F.col("n") > 0).select("slug", F.col("first").cast("string").alias("first"), "days")


@query("ready_sources", "SELECT source, row_number() OVER (ORDER BY priority, n, source) AS place FROM (SELECT user_id AS source, user_id % 4 AS priority, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-01-30 20:00:00')")
def ready_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have cooled down, by priority and by how much of them is done."""
    counted = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    ready = counted.where("last <= timestamp_ntz'2024-01-30 20:00:00'").withColumn("priority", F.col("source") % 4)
    return ranks.ranked(ready, [F.col("priority"), F.col("n"), F.col("source")], "place").select("source", "place")


@query(
    "feed_items",
    """SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'T' || page_id ELSE 'Untitled' END AS title, CASE WHEN page_id % 7 = 0 THEN 'id:' || page_id ELSE url END AS link,
  CASE WHEN page_id % 4 < 2 THEN 'Tue, 04 Feb 2025 14:39:00 +0530' ELSE 'some day' END AS pub_date, CASE WHEN page_id % 2 = 0 THEN 'https://i.example/' || page_id || '.jpg' END AS image_url FROM pages WHERE page_id % 11 > 0 AND page_id % 4 <> 2""",
)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with and without titles, links, dates and images; old ones and those without any address go."""
    n = F.col("page_id")
    text = lambda c: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c))
    entries = load(spark, sf_dir, "pages").select(
        F.when(n % 5 > 0, text(["T", n])).alias("title"),
        F.when((n % 7 > 0) & (n % 11 > 0), F.col("url")).otherwise("").alias("link"),
        F.when((n % 7 == 0) & (n % 11 > 0), text(["id:", n])).alias("id"),
        F.when(n % 4 == 0, "Tue, 04 Feb 2025 14:39:00 +0530").when(n % 4 == 2, "Tue, 04 Feb 2020 14:39:00 +0530").when(n % 4 == 3, "some day").alias("published"),
        F.when(n % 4 == 1, "Tue, 04 Feb 2025 14:39:00 +0530").alias("updated"),
        F.when(n % 2 == 0, text(["<p><IMG alt='x' SRC=\"https://i.example/", n, ".jpg\"></p>"])).otherwise("<img src='/local.png'>").alias("summary"),
        n.alias("page_id"),
    )
    kept = crawl.feed_items(entries.withColumn("summary", F.concat("summary", F.lit("<!--"), n.cast("string"), F.lit("-->"))))
    return kept.select(F.regexp_extract("description", "<!--(\\d+)-->", 1).cast("long").alias("page_id"), "title", "link", "pub_date", "image_url")
