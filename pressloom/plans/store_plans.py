"""Queries on the store: scans, predicates, statistics and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.operators import dedup, links, select, stats
from pressloom.plans.registry import ORACLE, SQL_STAMP, query, stamp
from pressloom.session import checkpointed, load
from pressloom.sources.adapter import NOW, STORE_SQL, articles, attempts, source_table, store

count_if = lambda c: F.count(F.when(c, 1))

# scans


@query("active_sources", f"WITH {STORE_SQL} SELECT slug, name, language FROM source_table WHERE is_active")
def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_table(spark, sf_dir).where("is_active").orderBy(F.asc_nulls_last("name")).select("slug", "name", "language")


@query("source_by_slug", f"WITH {STORE_SQL} SELECT slug, name FROM source_table WHERE slug = 'quiet'")
def source_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_table(spark, sf_dir).where("slug = 'quiet'").limit(1).select("slug", "name")


@query("source_urls", f"WITH {STORE_SQL} SELECT DISTINCT slug, url FROM store WHERE slug IN (SELECT slug FROM source_table WHERE is_active)")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urls of the active sources: a semi join on the small dimension."""
    active = source_table(spark, sf_dir).where("is_active").select("slug")
    return articles(spark, sf_dir).select("slug", "url").join(F.broadcast(active), "slug", "left_semi").distinct()  # one row a source


@query("sampled_articles", f"WITH {STORE_SQL} SELECT id, slug FROM store WHERE slug <> 'src1' AND created_at >= TIMESTAMP '2024-01-10' ORDER BY md5('42|' || id), id LIMIT 40")
def sampled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of what optional predicates leave."""
    rows = select.where_given(store(spark, sf_dir).where("slug <> 'src1'"), created_at__since="2024-01-10", category=None)
    return select.sample(rows.select("id", "slug"), 40, "id")


@query("filtered_articles", f"WITH {STORE_SQL} SELECT id, slug, qa_status FROM store WHERE qa_status = 'pass' AND category IN ('politics', 'health') AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-25' AND location IS NOT NULL")
def filtered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.where_given(store(spark, sf_dir), qa_status="pass", category__in=["politics", "health"], created_at__since="2024-01-05", created_at__until="2024-01-25", location__null=False, slug=None)
    return rows.select("id", "slug", "qa_status")


@query("day_articles", f"WITH {STORE_SQL} SELECT id FROM store WHERE CAST(published_at AS DATE) = DATE '2024-01-12' OR CAST(created_at AS DATE) = DATE '2024-01-12'")
def day_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).where(select.on_day("published_at", "2024-01-12") | select.on_day("created_at", "2024-01-12")).select("id")


@query("recent_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS slug, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1999-10-01' GROUP BY 1, 2")
def recent_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by month and group from the month five before that of 17 March 2000 on."""
    rows = load(spark, sf_dir, "orders").where(select.since_months("o_orderdate", "2000-03-17", 6))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("slug")).agg(F.count("*").alias("n")).orderBy("month", "slug")


URLS_SQL = "u AS (SELECT page_id, 's' || (page_id % 3) AS slug, split_part(split_part(url, '#', 1), '?', 1) || ['', '/a.PDF', '/feed', '/tag/x/1', '/sports', '/?mode=head', '/2024/01/5', '/news?id=7'][page_id % 8 + 1] AS url FROM pages)"


def made_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls with endings of all kinds, by turns, and three sources."""
    ends = F.array(*map(F.lit, ("", "/a.PDF", "/feed", "/tag/x/1", "/sports", "/?mode=head", "/2024/01/5", "/news?id=7")))
    base = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    return load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("slug"), F.concat(base, F.element_at(ends, (F.col("page_id") % 8 + 1).cast("int"))).alias("url"))


@query("skip_urls", rf"WITH {URLS_SQL} SELECT page_id, url FROM u WHERE NOT regexp_matches(url, '(?i)(\.(jpg|jpeg|png|gif|svg|webp|pdf)$|/feed/?$|/print/?$|/wp-content/uploads/|/(category|tag|author|page)/|/(hot-news|news_archive|sports|entertainment-news)/?$|/\?mode=(beauti|head))')")
def skip_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_urls(spark, sf_dir).where(~select.skipped(F.col("url"))).select("page_id", "url")


@query(
    "allow_lists",
    rf"WITH {URLS_SQL} SELECT page_id, slug FROM u WHERE CASE slug WHEN 's0' THEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), '/\d{{4}}/\d{{2}}/|[?&]id=\d+') AND NOT regexp_matches(url, 'id=7$') WHEN 's1' THEN NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), '/feed|/tag/') ELSE true END",
)
def allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's own patterns: one with an allow list, one with a skip list, one with neither."""
    patterns = spark.createDataFrame([("s0", [r"/\d{4}/\d{2}/", r"[?&]id=\d+"], ["id=7$"]), ("s1", [], ["/feed", "/tag/"])], "slug string, allow array<string>, skip array<string>")
    return select.allowed(made_urls(spark, sf_dir), patterns).select("page_id", "slug")


@query("valid_rows", f"WITH {STORE_SQL} SELECT id, array_to_string(list_filter([CASE WHEN qa_status IN ('pass', 'warn', 'fail') THEN NULL ELSE 'status' END, CASE WHEN qa_score BETWEEN 1 AND 8 THEN NULL ELSE 'score' END], lambda x: x IS NOT NULL), ',') AS broken FROM store")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against an enumeration and a range; those that break one are marked, not lost."""
    found = select.split_valid(store(spark, sf_dir), status=F.col("qa_status").isin("pass", "warn", "fail"), score=F.col("qa_score").between(1, 8))
    return found.select("id", F.array_join("broken", ",").alias("broken"))


@query(
    "valid_days",
    "SELECT o_orderkey AS id, o_orderkey % 5 = 0 OR o_orderkey % 5 = 3 AND year(o_orderdate) % 4 = 0 AS valid FROM orders",
)
def valid_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as a user may give them: right, out of range, empty, a 29 February, in another form."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    day = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-99-99")).when(k == 2, "").when(k == 3, F.date_format(at, "yyyy-02-29")).otherwise(F.date_format(at, "dd/MM/yyyy"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), select.valid_day(day).alias("valid"))


# statistics


@query(
    "source_stats",
    f"WITH {STORE_SQL} SELECT s.slug, s.name, COUNT(a.id) AS article_count, strftime(MAX(a.published_at), '{SQL_STAMP}') AS last_published, COUNT(a.id) FILTER (WHERE a.qa_status IS NULL) AS unreviewed FROM source_table s LEFT JOIN store a ON a.slug = s.slug GROUP BY s.slug, s.name",
)
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, those without articles too. Articles are counted before the join."""
    counted = articles(spark, sf_dir, reviewed=True).groupBy("slug").agg(F.count("*").alias("article_count"), F.max("published_at").alias("last_published"), count_if(F.col("qa_status").isNull()).alias("unreviewed"))
    found = source_table(spark, sf_dir).join(counted, "slug", "left")
    return found.select("slug", "name", F.coalesce("article_count", F.lit(0)).alias("article_count"), stamp("last_published"), F.coalesce("unreviewed", F.lit(0)).alias("unreviewed"))


@query("pipeline_status", f"WITH {STORE_SQL} SELECT count(*) AS articles, count(DISTINCT slug) AS sources, count(*) FILTER (WHERE qa_status IS NULL) AS unreviewed FROM store")
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the per-source rows."""
    return source_stats(spark, sf_dir).agg(F.sum("article_count").alias("articles"), count_if(F.col("article_count") > 0).alias("sources"), F.sum("unreviewed").alias("unreviewed"))


@query(
    "dashboard_sources",
    f"""WITH {STORE_SQL}, dead AS (SELECT 'src' || (CAST(substr(user_id::VARCHAR, 1, 20) AS BIGINT) % 20) AS slug, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT s.slug, s.name, s.language, s.is_active, COUNT(a.id) AS total, COUNT(a.id) FILTER (WHERE qa_status IS NOT NULL) AS reviewed, COUNT(a.id) FILTER (WHERE qa_status = 'pass') AS qa_pass,
  COUNT(a.id) FILTER (WHERE qa_status = 'warn') AS qa_warn, COUNT(a.id) FILTER (WHERE qa_status = 'fail') AS qa_fail, COUNT(a.id) FILTER (WHERE category IS NOT NULL) AS categorized,
  COUNT(a.id) FILTER (WHERE graph_saved) AS graph_saved, strftime(MAX(published_at), '{SQL_STAMP}') AS latest_article, strftime(MAX(created_at), '{SQL_STAMP}') AS latest_scrape,
  coalesce(any_value(dead.n), 0) AS dead_links FROM source_table s LEFT JOIN store a ON a.slug = s.slug LEFT JOIN dead ON dead.slug = s.slug GROUP BY ALL""",
)
def dashboard_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven conditional counts, two latest times and the failing links of every source, the largest first."""
    names = ["total", "reviewed", "qa_pass", "qa_warn", "qa_fail", "categorized", "graph_saved"]
    tests = [F.lit(True), F.col("qa_status").isNotNull(), *(F.col("qa_status") == s for s in ("pass", "warn", "fail")), F.col("category").isNotNull(), F.col("graph_saved")]
    counted = store(spark, sf_dir).groupBy("slug").agg(*(count_if(t).alias(n) for n, t in zip(names, tests, strict=True)), F.max("published_at").alias("latest_article"), F.max("created_at").alias("latest_scrape"))
    failing = attempts(spark, sf_dir).where("failed").select(F.concat(F.lit("src"), (F.substring("url", 2, 20).cast("long") % 20).cast("string")).alias("slug"), "url")
    lost = failing.groupBy("slug").agg(F.count_distinct("url").alias("dead_links"))
    found = source_table(spark, sf_dir).join(counted, "slug", "left").join(lost, "slug", "left").orderBy(F.desc_nulls_last("total"), "slug")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("slug", "name", "language", "is_active", *map(zero, names), stamp("latest_article"), stamp("latest_scrape"), zero("dead_links"))


@query(
    "dead_link_sources",
    f"""WITH {STORE_SQL}, d AS (SELECT 'src' || (user_id % 15) AS slug, count(*) - 1 AS retries, CASE max(event_id) % 4 WHEN 0 THEN '404' WHEN 1 THEN 'timeout' WHEN 2 THEN 'empty' ELSE '503' END AS kind
  FROM events WHERE event_type = 'error' GROUP BY user_id, event_id % 31)
SELECT s.slug, s.name, COUNT(d.slug) AS total, COUNT(d.slug) FILTER (WHERE retries >= 3) AS permanent, COUNT(d.slug) FILTER (WHERE retries < 3) AS retryable, COUNT(d.slug) FILTER (WHERE kind = '404') AS err_404,
  COUNT(d.slug) FILTER (WHERE kind = 'timeout') AS err_timeout, COUNT(d.slug) FILTER (WHERE kind = 'empty') AS err_empty, COUNT(d.slug) FILTER (WHERE kind NOT IN ('404', 'timeout', 'empty')) AS err_other
FROM source_table s LEFT JOIN d ON d.slug = s.slug GROUP BY s.slug, s.name HAVING COUNT(d.slug) > 0""",
)
def dead_link_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing links by source and kind; sources without any have no row."""
    failed = attempts(spark, sf_dir).where("failed").withColumn("fine", F.col("seq") % 31)
    state = failed.groupBy("url", "fine").agg((F.count("*") - 1).alias("retries"), F.max(F.struct("seq", "error_type"))["error_type"].alias("kind"))
    counted = stats.by_kind(state.withColumn("slug", F.concat(F.lit("src"), (F.substring("url", 2, 20).cast("long") % 15).cast("string"))), "slug")
    return source_table(spark, sf_dir).select("slug", "name").join(counted, "slug").orderBy(F.desc("total"), "slug")


@query("article_counts", f"WITH {STORE_SQL} SELECT count(*) AS every, count(*) FILTER (WHERE qa_status IS NULL) AS unreviewed, count(s.slug) AS of_active FROM store a LEFT JOIN (SELECT slug FROM source_table WHERE is_active) s ON s.slug = a.slug")
def article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles, the unreviewed, and those of active sources: counted by source first."""
    counted = articles(spark, sf_dir, reviewed=True).groupBy("slug").agg(F.count("*").alias("n"), count_if(F.col("qa_status").isNull()).alias("open"))
    active = source_table(spark, sf_dir).select("slug", "is_active")
    return counted.join(active, "slug", "left").agg(F.sum("n").alias("every"), F.sum("open").alias("unreviewed"), F.coalesce(F.sum(F.when(F.col("is_active"), F.col("n"))), F.lit(0)).alias("of_active"))


MATRIX_DAYS = [f"2024-01-{d:02d}" for d in range(1, 11)]


@query(
    "coverage_matrix",
    f"""WITH {STORE_SQL}, g AS (SELECT slug, strftime(published_at, '%Y-%m-%d') AS day FROM store WHERE slug <> 'src2' OR id % 2 = 0),
m AS (SELECT s.slug, {', '.join(f"COUNT(*) FILTER (WHERE day = '{d}') AS d{d[-2:]}" for d in MATRIX_DAYS)} FROM source_table s LEFT JOIN g ON g.slug = s.slug GROUP BY s.slug),
t AS (SELECT *, {' + '.join(f'd{d[-2:]}' for d in MATRIX_DAYS)} AS total, {' + '.join(f'CAST(d{d[-2:]} = 0 AS INT)' for d in MATRIX_DAYS)} AS gaps FROM m)
SELECT *, total / 10 AS mean FROM t WHERE gaps >= 1""",
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by source and day as a matrix, of sources with a day or more without any; days are given, so the pivot is one aggregate."""
    rows = articles(spark, sf_dir).where("slug <> 'src2' or id % 2 = 0").select("slug", F.date_format("published_at", "yyyy-MM-dd").alias("day")).where(F.col("day").isin(MATRIX_DAYS))
    counted = rows.groupBy("slug").pivot("day", MATRIX_DAYS).count()
    cell = {f"d{d[-2:]}": F.coalesce(F.col(f"`{d}`"), F.lit(0)) for d in MATRIX_DAYS}
    wide = source_table(spark, sf_dir).select("slug").join(counted, "slug", "left").select("slug", *(c.alias(n) for n, c in cell.items()))
    wide = wide.withColumns({"total": sum((F.col(n) for n in cell), F.lit(0)), "gaps": sum(((F.col(n) == 0).cast("int") for n in cell), F.lit(0))})
    return wide.where("gaps >= 1").withColumn("mean", F.col("total") / len(MATRIX_DAYS))


@query("monthly_totals", "SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'all') AS month, coalesce(o_orderstatus, 'all') AS slug, COUNT(*) AS n FROM orders GROUP BY ROLLUP (strftime(o_orderdate, '%Y-%m'), o_orderstatus)")
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by month and group with the months' totals and the grand total."""
    rows = load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("slug"))
    return rows.rollup("month", "slug").agg(F.count("*").alias("n")).select(F.coalesce("month", F.lit("all")).alias("month"), F.coalesce("slug", F.lit("all")).alias("slug"), "n")


@query(
    "tick_error_rate",
    "WITH t AS (SELECT strftime(ts, '%Y-%m-%d %H') AS tick, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS scraped FROM events GROUP BY 1) SELECT tick, errors / greatest(scraped, 1) AS rate, errors / greatest(scraped, 1) >= 0.3 AS back_off FROM t",
)
def tick_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between ticks, new errors by new items, at least one: what a pool backs off by."""
    ticks = load(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("tick")).agg(count_if(F.col("event_type") == "error").alias("errors"), count_if(F.col("event_type") == "view").alias("scraped"))
    rate = F.col("errors") / F.greatest("scraped", F.lit(1))
    return ticks.select("tick", rate.alias("rate"), (rate >= 0.3).alias("back_off"))


@query("day_bars", "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, greatest(n / max(n) OVER () * 32, 2) AS height FROM d")
def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 2 to 32 by the largest day."""
    days = load(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("height", F.greatest(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))) * 32, F.lit(2.0)))  # one row a day


@query("models_by_reviews", f"WITH {STORE_SQL} SELECT reviewed_by, COUNT(*) AS n FROM store WHERE reviewed_by IS NOT NULL GROUP BY reviewed_by")
def models_by_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).where("reviewed_by is not null").groupBy("reviewed_by").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reviewed_by")


@query("positive_counts", "SELECT event_type, n FROM (SELECT event_type, count(*) FILTER (WHERE value > 180) AS n FROM events GROUP BY 1) WHERE n > 0")
def positive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(count_if(F.col("value") > 180).alias("n")).where("n > 0").orderBy(F.desc("n"), "event_type")


@query("reviewed_latest", f"WITH {STORE_SQL} SELECT id, strftime(reviewed_at, '{SQL_STAMP}') AS reviewed_at FROM store WHERE qa_status = 'pass' AND graph_saved = false ORDER BY store.reviewed_at DESC NULLS FIRST, id LIMIT 30")
def reviewed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed articles that the graph lacks, the latest review first."""
    rows = store(spark, sf_dir).where("qa_status = 'pass' and graph_saved = false").select("id", "reviewed_at")
    return rows.orderBy(F.desc_nulls_first("reviewed_at"), "id").limit(30).select("id", stamp("reviewed_at"))


@query("page_with_sources", f"WITH {STORE_SQL} SELECT a.id, a.title, s.name AS source_name, s.slug AS source_slug FROM store a JOIN source_table s ON s.slug = a.slug ORDER BY a.published_at DESC NULLS LAST, a.id LIMIT 25 OFFSET 5")
def page_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of articles with their sources' names."""
    named = source_table(spark, sf_dir).select(F.col("slug").alias("source_slug"), F.col("name").alias("source_name"))
    rows = articles(spark, sf_dir).select("id", "title", "slug", "published_at").join(F.broadcast(named), F.col("slug") == F.col("source_slug"))  # one row a source
    return rows.orderBy(F.desc_nulls_last("published_at"), "id").offset(5).limit(25).select("id", "title", "source_name", "source_slug")


@query("first_then_known", "WITH c AS (SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 200) SELECT event_id FROM c WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def first_then_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before what is known is left out, so fewer rows may remain."""
    first = load(spark, sf_dir, "events").select("event_id", "user_id", "ts").orderBy("ts", "event_id").limit(200)
    known = load(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    return first.join(known, "user_id", "left_anti").select("event_id")


# mutations


@query(
    "record_dead_links",
    f"""WITH a AS (SELECT 'u' || user_id || '/' || (event_id % 31) AS url, ts AS tried, event_type = 'error' AS failed, event_type = 'view' AS fine, CASE event_id % 4 WHEN 0 THEN '404' WHEN 1 THEN 'timeout' WHEN 2 THEN 'empty' ELSE '503' END AS kind FROM events),
old AS (SELECT url, count(*) - 1 AS retry_count, min(tried) AS first_failed_at, max(tried) AS last_checked_at, arg_max(kind, (tried, kind)) AS error_type FROM a WHERE failed AND tried < TIMESTAMP '2024-01-20' GROUP BY url),
f AS (SELECT url, count(*) AS n, min(tried) AS first, max(tried) AS last, arg_max(kind, (tried, kind)) AS kind FROM a WHERE failed AND tried >= TIMESTAMP '2024-01-20' GROUP BY url),
ok AS (SELECT DISTINCT url FROM a WHERE fine AND tried >= TIMESTAMP '2024-01-28')
SELECT url, coalesce(retry_count + coalesce(n, 0), n - 1) AS retry_count, strftime(coalesce(first_failed_at, first), '{SQL_STAMP}') AS first_failed_at, strftime(coalesce(last, last_checked_at), '{SQL_STAMP}') AS last_checked_at,
  coalesce(kind, error_type) AS error_type FROM old FULL JOIN f USING (url) WHERE url NOT IN (SELECT url FROM ok)""",
)
def record_dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of failing links before 20 January, and a run's failures and successes recorded in it."""
    kinds = F.element_at(F.array(*map(F.lit, ("404", "timeout", "empty", "503"))), (F.col("event_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 31).cast("string"))
    tries = load(spark, sf_dir, "events").select(url.alias("url"), F.col("ts").alias("tried"), "event_type", kinds.alias("error_type"))
    failed, cut = tries.where("event_type = 'error'"), select.stamp_of("2024-01-20")
    state = failed.where(F.col("tried") < cut).groupBy("url").agg((F.count("*") - 1).alias("retry_count"), F.min("tried").alias("first_failed_at"), F.max("tried").alias("last_checked_at"), F.max(F.struct("tried", "error_type"))["error_type"].alias("error_type"))
    fine = tries.where("event_type = 'view' and tried >= timestamp_ntz'2024-01-28'").select("url").distinct()
    found = links.recorded(state, failed.where(F.col("tried") >= cut), fine)
    return found.select("url", "retry_count", stamp("first_failed_at"), stamp("last_checked_at"), "error_type")


@query(
    "update_reviews",
    f"""WITH {STORE_SQL} SELECT id, CASE WHEN id % 4 = 1 THEN CASE WHEN id % 8 = 1 THEN 'fail' ELSE 'pass' END ELSE qa_status END AS qa_status, CASE WHEN id % 4 = 1 THEN CASE WHEN id % 8 = 1 THEN '[{{"type":"truncated"}}]' END END AS qa_issues,
  CASE WHEN id % 4 = 1 THEN '{NOW}' ELSE strftime(reviewed_at, '{SQL_STAMP}') END AS reviewed_at FROM store""",
)
def update_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the articles get reviews: status, issues (null where there are none) and time; the rest stay."""
    table = store(spark, sf_dir).select("id", "qa_status", F.lit(None).cast("string").alias("qa_issues"), "reviewed_at")
    bad = F.col("id") % 8 == 1
    issues = F.when(bad, F.array(F.struct(F.lit("truncated").alias("type")))).otherwise(F.array().cast("array<struct<type:string>>"))
    changes = table.where("id % 4 = 1").select("id", F.when(bad, "fail").otherwise("pass").alias("qa_status"), F.when(F.size(issues) > 0, F.to_json(issues)).alias("qa_issues"), select.stamp_of(NOW).alias("reviewed_at"))
    return dedup.updated(table, changes, "id").select("id", "qa_status", "qa_issues", stamp("reviewed_at"))


@query("mark_saved", f"WITH {STORE_SQL} SELECT id, coalesce(graph_saved, false) OR qa_status = 'pass' AND id % 3 = 0 AS graph_saved FROM store WHERE qa_status IS NOT NULL")
def mark_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag of what was saved."""
    table = store(spark, sf_dir).where("qa_status is not null").select("id", "qa_status", "graph_saved")
    saved = table.where("qa_status = 'pass' and id % 3 = 0").select("id", F.lit(True).alias("graph_saved"))
    return dedup.updated(table, saved, "id").select("id", "graph_saved")


RUN_SQL = "runs AS (SELECT event_id AS run, ts AS started_at, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 90 SECOND END AS finished_at, event_type AS kind, CASE WHEN event_id % 5 > 0 THEN props END AS stats FROM events WHERE event_type IN ('error', 'signup'))"


@query("run_history", f"WITH {RUN_SQL} SELECT run, kind, strftime(started_at, '{SQL_STAMP}') AS started_at, strftime(finished_at, '{SQL_STAMP}') AS finished_at, stats FROM runs ORDER BY runs.started_at DESC NULLS FIRST, run LIMIT 50")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs begun and, by a keyed update, finished; the latest first."""
    events = load(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    begun = events.select(F.col("event_id").alias("run"), F.col("event_type").alias("kind"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("stats"))
    done = events.where("event_id % 5 > 0").select(F.col("event_id").alias("run"), (F.col("ts") + F.expr("interval 90 seconds")).alias("finished_at"), F.col("props").alias("stats"))
    latest = dedup.updated(begun, done, "run").orderBy(F.desc_nulls_first("started_at"), "run").limit(50)
    return latest.select("run", "kind", stamp("started_at"), stamp("finished_at"), "stats")


SIDES_SQL = """own AS (SELECT doc_id % 700 AS k, 'own' || doc_id AS said FROM documents WHERE doc_id < 600), other AS (SELECT doc_id AS k, 'other' || doc_id AS said FROM documents WHERE doc_id % 3 = 0)"""


@query("sync_stores", f"WITH {SIDES_SQL} SELECT k, said FROM own UNION ALL SELECT k, said FROM other WHERE k NOT IN (SELECT k FROM own)")
def sync_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stores' rows by key; on a conflict each side keeps its own."""
    docs = load(spark, sf_dir, "documents")
    own = docs.where("doc_id < 600").select((F.col("doc_id") % 700).alias("k"), F.concat(F.lit("own"), F.col("doc_id").cast("string")).alias("said"))
    other = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), F.concat(F.lit("other"), F.col("doc_id").cast("string")).alias("said"))
    return dedup.synced(own, other, "k")


@query(
    "backup_remap",
    "SELECT s_suppkey AS id, n_nationkey + 100 AS source_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 UNION ALL SELECT -1, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2",
)
def backup_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows get the other store's keys through their sources' names; the last row counts those whose name it lacks."""
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("slug"), "n_regionkey")
    other = nation.where("n_regionkey <> 2").withColumn("source_id", F.col("source_id") + 100)
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("source_id"))
    moved = dedup.remapped(rows, nation, other, "source_id", "slug")
    lost = rows.join(moved.select("id"), "id", "left_anti").agg(F.lit(-1).cast("long").alias("id"), F.count("*").alias("source_id"))
    return moved.unionByName(lost)


@query(
    "ingest_outcomes",
    f"""WITH {STORE_SQL}, t AS (SELECT id AS seq, slug, CASE WHEN id % 11 = 0 THEN 'https://x.example/' || (id % 33) ELSE url END AS url, title, content, CASE WHEN id % 13 = 0 THEN '404' END AS error, CASE WHEN id % 7 > 0 THEN published_at END AS published_at,
  regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '[^\\p{{L}}\\p{{N}}_\\x{{200C}}\\x{{200D}}]', '', 'g') AS key FROM store WHERE id % 4 > 0),
k AS (SELECT slug, url, regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '[^\\p{{L}}\\p{{N}}_\\x{{200C}}\\x{{200D}}]', '', 'g') AS key FROM store WHERE id % 4 = 0),
s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'dead_link' WHEN length(coalesce(content, '')) < 100 THEN 'failed' WHEN published_at IS NULL THEN 'skipped_no_date'
  WHEN url IN (SELECT url FROM k) OR EXISTS (SELECT 1 FROM k WHERE k.slug = t.slug AND k.key = t.key AND length(k.key) > 10) THEN 'skipped_duplicate' END AS stage FROM t),
u AS (SELECT *, stage IS NULL AND row_number() OVER (PARTITION BY stage, url ORDER BY seq) = 1 AS first_url FROM s),
v AS (SELECT *, min(CASE WHEN first_url AND length(key) > 10 THEN seq END) OVER (PARTITION BY slug, key) AS first_title FROM u)
SELECT seq, coalesce(stage, CASE WHEN first_url AND seq <= coalesce(first_title, seq) THEN 'inserted' ELSE 'skipped_duplicate' END) AS outcome FROM v""",
)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's items by what becomes of them, against a store of a quarter of the articles."""
    return dedup.outcomes(*run_of(spark, sf_dir)).select("seq", "outcome")


def run_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(attempts of a run, the store)."""
    every = articles(spark, sf_dir)
    tried = every.where("id % 4 > 0").select(
        F.col("id").alias("seq"), "slug", F.when(F.col("id") % 11 == 0, F.concat(F.lit("https://x.example/"), (F.col("id") % 33).cast("string"))).otherwise(F.col("url")).alias("url"), "title", "content",
        F.when(F.col("id") % 13 == 0, "404").alias("error"), F.when(F.col("id") % 7 > 0, F.col("published_at")).alias("published_at"),
    )
    return tried, every.where("id % 4 = 0")


@query("ingest_tallies", f"WITH o AS ({ORACLE['ingest_outcomes']}), n AS (SELECT outcome, count(*) AS n FROM o GROUP BY outcome UNION ALL SELECT 'attempts', count(*) FROM o UNION ALL SELECT 'without_date', count(*) FROM o WHERE seq % 7 = 0) SELECT outcome, n FROM n WHERE n > 0")
def ingest_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's counts, observed in the pass that writes its outcomes."""
    tally = Observation("run")
    checkpointed(dedup.outcomes(*run_of(spark, sf_dir), tally=tally))
    return spark.createDataFrame([(name, n) for name, n in tally.get.items() if n], "outcome string, n long")


@query("known_or_dead", f"WITH {STORE_SQL} SELECT DISTINCT url FROM (SELECT url FROM store WHERE id % 2 = 0 UNION ALL SELECT url FROM store WHERE qa_status = 'fail')")
def known_or_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls that are stored or given up."""
    rows = store(spark, sf_dir)
    return rows.where("id % 2 = 0").select("url").union(rows.where("qa_status = 'fail'").select("url")).distinct()


@query("snapshot_name", "SELECT DISTINCT 'db/store-nightly-' || strftime(date_trunc('day', ts), '%Y%m%d-%H%M%S') AS name FROM events")
def snapshot_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of nightly snapshots of the days on which something happened."""
    days = load(spark, sf_dir, "events").select(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")).distinct()
    return days.select(F.concat(F.lit("db/store-nightly-"), F.date_format("day", "yyyyMMdd-HHmmss")).alias("name"))
