"""The driver's tables seen as a news store: articles, sources, dead links and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.session import load

#: The fixed present of all queries; nothing reads a clock.
NOW = "2024-01-31 00:00:00"

#: The same view in DuckDB SQL, for oracles.
ARTICLES_SQL = """articles AS (
  SELECT d.doc_id AS id, d.source AS slug, d.lang AS language, d.text AS content, d.n_chars,
         substr(split_part(d.text, chr(10), 1), 1, 120) AS title,
         'https://' || d.source || '.example/' || d.doc_id AS url,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id * 7919 % 43200 AS BIGINT)) AS published_at,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'fail' WHEN l.quality = 1 THEN 'pass' ELSE 'warn' END AS qa_status,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 9 ELSE 6 END AS qa_score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def articles(spark: SparkSession, sf_dir: str, reviewed: bool = False) -> DataFrame:
    """One row per document: id, slug, language, content, n_chars, title, url, published_at, and if ``reviewed`` qa_status, qa_score.

    A document without a label is unreviewed: both QA columns are null. Without
    ``reviewed`` the labels are neither read nor joined.
    """
    if not reviewed:
        return _columns(load(spark, sf_dir, "documents"))
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    labelled = F.col("label_id").isNotNull()
    ladder = lambda fail, good, other: F.when(labelled & (F.col("toxic") == 1), fail).when(labelled & (F.col("quality") == 1), good).when(labelled, other)
    found = docs.join(labels, docs.doc_id == labels.label_id, "left")
    return _columns(found, ladder("fail", "pass", "warn").alias("qa_status"), ladder(2, 9, 6).cast("int").alias("qa_score"))


def _columns(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("slug"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        "n_chars",
        F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 7919 % 43200 as int))").alias("published_at"),
        *more,
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, name, language): every source, with its most frequent language, ties to the smallest."""
    counted = load(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("slug"), "lang").agg(F.count("*").alias("n"))
    best = counted.groupBy("slug").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("language"))
    return best.select("slug", F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))).alias("name"), "language")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, tried, seq, failed, error_type): fetch attempts, from the events."""
    kind = F.element_at(F.array(*map(F.lit, ("404", "timeout", "empty", "503"))), (F.col("event_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("tried"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), kind.alias("error_type")
    )


ATTEMPTS_SQL = """attempts AS (
  SELECT 'u' || user_id AS url, ts AS tried, event_id AS seq, event_type = 'error' AS failed,
         CASE event_id % 4 WHEN 0 THEN '404' WHEN 1 THEN 'timeout' WHEN 2 THEN 'empty' ELSE '503' END AS error_type
  FROM events)"""


#: ``store`` and ``source_table`` in DuckDB SQL, after ARTICLES_SQL.
STORE_SQL = (
    ARTICLES_SQL
    + """, store AS (
  SELECT *, published_at + to_minutes(CAST(id % 180 AS BIGINT)) AS created_at, CASE WHEN qa_status IS NOT NULL THEN published_at + to_hours(CAST(24 + id % 30 AS BIGINT)) END AS reviewed_at,
    CASE WHEN qa_status IS NOT NULL THEN 'model-' || (id % 3) END AS reviewed_by, CASE WHEN qa_status = 'pass' THEN ['politics', 'sports', 'health'][id % 3 + 1] END AS category,
    CASE WHEN qa_status IS NOT NULL THEN id % 2 = 0 END AS graph_saved, CASE WHEN id % 5 = 0 THEN 'Colombo' WHEN id % 5 = 1 THEN '' END AS location,
    'src' || (id % 23) AS story FROM articles),
source_table AS (
  SELECT slug, upper(substr(slug, 1, 1)) || substr(slug, 2) AS name, language, slug NOT LIKE '%3' AS is_active FROM (
    SELECT source AS slug, lang AS language, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE source IS NOT NULL GROUP BY source, lang) WHERE r = 1
  UNION ALL SELECT 'quiet', 'Quiet', 'en', true)"""
)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed articles with created_at, reviewed_at, reviewed_by, category, graph_saved, location and a story, derived from their numbers."""
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))
    hours = lambda h: F.make_dt_interval(F.lit(0), h.cast("int"))
    known, number = F.col("qa_status").isNotNull(), F.col("id")
    pick = F.element_at(F.array(*map(F.lit, ("politics", "sports", "health"))), (number % 3 + 1).cast("int"))
    return articles(spark, sf_dir, reviewed=True).withColumns(
        {
            "created_at": F.col("published_at") + minutes(number % 180),
            "reviewed_at": F.when(known, F.col("published_at") + hours(24 + number % 30)),
            "reviewed_by": F.when(known, F.concat(F.lit("model-"), (number % 3).cast("string"))),
            "category": F.when(F.col("qa_status") == "pass", pick),
            "graph_saved": F.when(known, number % 2 == 0),
            "location": F.when(number % 5 == 0, "Colombo").when(number % 5 == 1, ""),
            "story": F.concat(F.lit("src"), (number % 23).cast("string")),
        }
    )


def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, name, language, is_active): the sources and one that has no articles."""
    every = sources(spark, sf_dir).select("slug", "name", "language", (~F.endswith("slug", F.lit("3"))).alias("is_active"))
    return every.unionByName(spark.createDataFrame([("quiet", "Quiet", "en", True)], every.schema))
