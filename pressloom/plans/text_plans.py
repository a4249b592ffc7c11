"""Queries on text, links and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import select
from pressloom.plans.registry import query
from pressloom.session import load
from pressloom.sources.adapter import ARTICLES_SQL, STORE_SQL, articles, store

MARKS = ["&amp; &eacute;", "e\u0301\u00a0&#8217;s", "\u2003\t&lt;b&gt;  ", "Ã¢â\u201aÂ¬â\u201e¢ &copy;", "&nosuch; &#x41;"]
READ = ["& é", "é ’s", "<b>", "’ ©", "&nosuch; A"]


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query("normalized_text", f"SELECT doc_id AS id, trim(regexp_replace(nfc_normalize('t' || doc_id || ' ' || [{quoted(READ)}][doc_id % 5 + 1] || ' ' || coalesce(lang, '')), '\\s+', ' ', 'g')) AS said FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, decomposed letters, double-encoded quotes and all kinds of white space, put right."""
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("doc_id") % len(MARKS) + 1).cast("int"))
    said = F.concat(F.lit("  t"), F.col("doc_id").cast("string"), F.lit(" \n"), mark, F.lit("\u00a0 "), F.coalesce("lang", F.lit("")))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.normalized(said).alias("said"))


LEADS = [
    ("By Ann B. Writer Colombo says", "Ann B. Writer", " Colombo says"),
    ("By Ann Writer POLICE said", "Ann Writer", " POLICE said"),
    ("Colombo, Feb. 13 (Daily Mirror) - It rained", None, "It rained"),
    ("Feb.13 - It rained", None, "It rained"),
    ("COLOMBO (News 1st); It rained", None, "It rained"),
    ("ECONOMYNEXT – It rained", None, "It rained"),
    ("Colombo, 14th February (DailyMirror) -Feb.14 (Mirror Sports) - It rained", None, "It rained"),
    ("It rained, by all accounts", None, "It rained, by all accounts"),
]
AUTHORS = [("by Z. Farzan 14-02-2026 | 3:44 AM", "Z. Farzan"), ("By Ann", "Ann"), ("Bystander", "Bystander"), ("by 1/2/2024", None), ("", None)]


def picked(values: list[str], by: str) -> str:
    """SQL for one of some texts by a number's remainder."""
    return f"[{', '.join('NULL' if v is None else quoted([v]) for v in values)}][{by} % {len(values)} + 1]"


@query("bylines", f"SELECT doc_id AS id, {picked([a for _, a, _ in LEADS], 'doc_id')} AS author, md5({picked([r for *_, r in LEADS], 'doc_id')} || chr(10) || coalesce(lang, '') || ' ' || coalesce(source, '')) AS content FROM documents")
def bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors taken from the beginnings of contents, and contents without bylines and datelines."""
    lead = F.element_at(F.array(*(F.lit(x) for x, *_ in LEADS)), (F.col("doc_id") % len(LEADS) + 1).cast("int"))
    rest = F.concat(F.lit("\n"), F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(lead, rest).alias("c"))
    return rows.select("id", text.byline(F.col("c")).alias("author"), F.md5(text.without_byline(F.col("c"))).alias("content"))


@query("authors", f"SELECT doc_id AS id, coalesce({picked([b for _, b in AUTHORS], 'doc_id')}, '') || CASE WHEN {picked([b for _, b in AUTHORS], 'doc_id')} IS NULL THEN '' ELSE coalesce(' of ' || source, '') END AS author FROM documents")
def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as pages give them, without what stands around them; each with its article's source."""
    said = F.element_at(F.array(*(F.lit(a) for a, _ in AUTHORS)), (F.col("doc_id") % len(AUTHORS) + 1).cast("int"))
    name = text.clean_author(said)
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.concat(name, F.coalesce(F.concat(F.lit(" of "), "source"), F.lit(""))), F.lit("")).alias("author"))


@query("composed_titles", f"WITH {STORE_SQL} SELECT id, coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE title END, ''), 'Article ' || id) AS title, coalesce(title, '') || '. ' || substr(coalesce(content, ''), 1, 200) AS said, coalesce(nullif(location, ''), slug) AS place FROM store")
def composed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty counts as missing: titles fall back to the number, places to the source; what is embedded is title and beginning."""
    rows = store(spark, sf_dir)
    title = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title"))
    said = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("content", F.lit("")), 1, 200))
    return rows.select("id", select.or_else(title, F.concat(F.lit("Article "), F.col("id").cast("string"))).alias("title"), said.alias("said"), select.or_else("location", "slug").alias("place"))


@query("hues", "SELECT n_name AS name, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: c + ((h * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 - h)) % 360 AS hue FROM nation")
def hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), text.fallback_hue(F.col("n_name")).alias("hue"))


ANSWERS = "['```json' || chr(10) || body || chr(10) || '```', 'Here: ```' || body || '``` done', body, 'no json ' || body]"


@query("model_answers", "SELECT event_id AS id, CASE WHEN event_id % 4 < 3 THEN 'pass' END AS status, CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 10 + 1 AS INTEGER) END AS score FROM events")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of models' answers, fenced or bare; what is no JSON gives nulls."""
    body = F.to_json(F.struct(F.lit("pass").alias("status"), (F.col("event_id") % 10 + 1).alias("score")))
    forms = F.array(F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here: ```"), body, F.lit("``` done")), body, F.concat(F.lit("no json "), body))
    answer = F.element_at(forms, (F.col("event_id") % 4 + 1).cast("int"))
    read = F.from_json(text.fenced_json(answer), "status string, score int").alias("r")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), read).select("id", "r.status", "r.score")


@query("error_classes", "SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN 'timeout' WHEN event_id % 19 = 0 THEN 'unknown' WHEN event_id % 5 = 0 THEN '404' WHEN event_id % 5 = 1 THEN '503' WHEN event_id % 7 = 0 THEN 'cloudflare' WHEN floor(value) < 100 THEN 'empty' END AS error FROM events")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetch failed by: a break before a code, a code before a challenge, a challenge before a short text."""
    n = F.col("event_id")
    status = F.when(n % 5 == 0, 404).when(n % 5 == 1, 503).otherwise(200)
    failure = F.when(n % 17 == 0, "TimeoutError").when(n % 19 == 0, "ValueError")
    return load(spark, sf_dir, "events").select(n.alias("id"), text.error_class(status, F.floor("value"), n % 7 == 0, failure).alias("error"))


@query("display_marks", f"WITH {STORE_SQL} SELECT id, CASE WHEN qa_score >= 7 THEN 'green' WHEN qa_score >= 4 THEN 'yellow' WHEN qa_score IS NOT NULL THEN 'red' END AS badge, array_to_string([slug, language, coalesce(category, 'none')][1:2], ', ') || ' +1 more' AS tags, CASE WHEN length(title) > 30 THEN regexp_replace(substr(title, 1, 30), '\\s+$', '') || '...' ELSE title END AS short FROM store")
def display_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array("slug", "language", F.coalesce("category", F.lit("none")))
    return store(spark, sf_dir).select("id", text.badge(F.col("qa_score")).alias("badge"), text.first_of(tags, 2).alias("tags"), text.truncated(F.col("title"), 30).alias("short"))


@query("url_queries", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^?#]*\\?([^#]*)', 1) AS query, split_part(url, '#', 1) AS canonical FROM pages")
def url_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.url_query(F.col("url")).alias("query"), F.substring_index("url", "#", 1).alias("canonical"))


@query("json_rows", f"WITH {ARTICLES_SQL} SELECT id, '{{\"id\":' || id || ',\"slug\":\"' || slug || '\",\"tags\":[\"' || language || '\",\"' || slug || '\"],\"published_at\":\"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S.000') || '\"}}' AS body FROM articles WHERE slug IS NOT NULL AND language IS NOT NULL")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON, nested values too."""
    rows = articles(spark, sf_dir).where("slug is not null and language is not null")
    return rows.select("id", F.to_json(F.struct("id", "slug", F.array("language", "slug").alias("tags"), "published_at")).alias("body"))


@query("row_ids", "SELECT count(*) AS n, count(*) AS n_different, count(*) AS n_formed FROM documents")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random identifiers differ from run to run; here, that all rows have one of their own and of the right form."""
    ids = load(spark, sf_dir, "documents").select(F.uuid().alias("id"))
    formed = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.groupBy("id").agg(F.count("*").alias("k"), F.max(formed.cast("int")).alias("f")).agg(F.sum("k").alias("n"), F.count("*").alias("n_different"), F.sum(F.col("f") * F.col("k")).alias("n_formed"))
