"""Queries on stories: their pages, details, refresh and a clustering run; and on the search index and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.operators import dedup, search, select, stories
from pressloom.operators.indexed import Index
from pressloom.plans.registry import ORACLE, SQL_STAMP, query, stamp
from pressloom.session import load, shared_folder
from pressloom.sources.adapter import STORE_SQL, articles, source_table, store

TABLE_SQL = f"""WITH {STORE_SQL}, stories AS (SELECT story, count(*) AS article_count, count(DISTINCT slug) AS source_count, min(published_at) AS first_published, max(published_at) AS last_published FROM store GROUP BY story)"""


def story_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir).select("story", "slug", "published_at")
    return rows.groupBy("story").agg(F.count("*").alias("article_count"), F.count_distinct("slug").alias("source_count"), F.min("published_at").alias("first_published"), F.max("published_at").alias("last_published"))


@query(
    "stories_with_sources",
    f"{TABLE_SQL}, p AS (SELECT DISTINCT story, name, s.slug FROM store a JOIN source_table s ON s.slug = a.slug), l AS (SELECT story, string_agg(name || ':' || slug, ',' ORDER BY name, slug) AS sources FROM p GROUP BY story) SELECT story, article_count, coalesce(sources, '') AS sources FROM stories LEFT JOIN l USING (story)",
)
def stories_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stories.with_sources(story_table(spark, sf_dir), store(spark, sf_dir), source_table(spark, sf_dir))
    return found.select("story", "article_count", F.array_join(F.transform("sources", lambda s: F.concat(s["name"], F.lit(":"), s["slug"])), ",").alias("sources"))


@query("stories_today", f"{TABLE_SQL} SELECT story, article_count FROM stories WHERE CAST(first_published AS DATE) = DATE '2024-01-30' OR CAST(last_published AS DATE) = DATE '2024-01-30' ORDER BY article_count DESC, last_published DESC NULLS FIRST, story LIMIT 50")
def stories_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that began or went on that day, the most covered first."""
    today = story_table(spark, sf_dir).where(select.on_day("first_published", "2024-01-30") | select.on_day("last_published", "2024-01-30"))
    return today.orderBy(F.desc("article_count"), F.desc_nulls_first("last_published"), "story").limit(50).select("story", "article_count")


@query("stories_total", f"{TABLE_SQL} SELECT story, (SELECT count(*) FROM stories) AS total FROM stories ORDER BY last_published DESC NULLS LAST, story LIMIT 6 OFFSET 6")
def stories_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of stories beside the number of all."""
    table = story_table(spark, sf_dir)
    page = table.orderBy(F.desc_nulls_last("last_published"), "story").offset(6).limit(6).select("story")
    return page.crossJoin(table.agg(F.count("*").alias("total")))  # one row


@query(
    "story_detail",
    f"WITH {STORE_SQL} SELECT row_number() OVER (ORDER BY qa_score DESC NULLS LAST, published_at ASC NULLS LAST, id) AS place, id, a.slug, s.name AS source_name FROM store a JOIN source_table s ON s.slug = a.slug WHERE story = 'src5'",
)
def story_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One story's articles with their sources' names, the best reviewed first."""
    own = store(spark, sf_dir).where("story = 'src5'").select("id", "slug", "qa_score", "published_at")
    rows = own.join(F.broadcast(source_table(spark, sf_dir).select("slug", F.col("name").alias("source_name"))), "slug")  # one row a source
    order = Window.orderBy(F.desc_nulls_last("qa_score"), F.asc_nulls_last("published_at"), "id")
    return rows.select(F.row_number().over(order).cast("long").alias("place"), "id", "slug", "source_name")  # one story


@query("featured_stories", f"{TABLE_SQL} SELECT story, row_number() OVER (ORDER BY article_count DESC, story) = 1 AS featured FROM stories WHERE source_count > 1 ORDER BY article_count DESC, story LIMIT 7")
def featured_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first story and those beside it."""
    top = story_table(spark, sf_dir).where("source_count > 1").orderBy(F.desc("article_count"), "story").limit(7)
    return top.select("story", (F.row_number().over(Window.orderBy(F.desc("article_count"), "story")) == 1).alias("featured"))  # seven rows


@query("stories_of_category", f"WITH {STORE_SQL} SELECT DISTINCT story FROM store WHERE category = 'sports'")
def stories_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with an article of the category: a semi join."""
    return story_table(spark, sf_dir).join(store(spark, sf_dir).where("category = 'sports'"), "story", "left_semi").select("story")


ASSIGNED_SQL = "a AS (SELECT id, slug, published_at, CASE WHEN id % 6 = 0 THEN 'src1' WHEN id % 6 = 1 THEN NULL ELSE story END AS story FROM store)"


@query(
    "refresh_stories",
    f"""{TABLE_SQL}, {ASSIGNED_SQL}, n AS (SELECT story, count(*) AS n, count(DISTINCT slug) AS s, min(published_at) AS f, max(published_at) AS l FROM a WHERE story IS NOT NULL GROUP BY story)
SELECT story, coalesce(n, 0) AS article_count, coalesce(s, 0) AS source_count, strftime(coalesce(f, first_published), '{SQL_STAMP}') AS first_published, strftime(coalesce(l, last_published), '{SQL_STAMP}') AS last_published FROM stories LEFT JOIN n USING (story)""",
)
def refresh_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of articles moves to another story, others leave theirs, and the stories' counts and times follow."""
    rows = store(spark, sf_dir).select("id", "slug", "published_at", "story")
    moved = rows.where("id % 6 < 2").select("id", F.when(F.col("id") % 6 == 0, "src1").alias("story"))
    now = dedup.updated(rows, moved, "id")
    found = stories.refreshed(story_table(spark, sf_dir), now.where("story is not null"))
    return found.select("story", "article_count", "source_count", stamp("first_published"), stamp("last_published"))


def run_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(new vectors in 48-hour windows, existing stories with their first vector): two thirds of the vectors against the others' labels."""
    dated = articles(spark, sf_dir).groupBy(F.col("id").alias("vec_id")).agg(F.max("published_at").alias("published_at"))
    vectors = load(spark, sf_dir, "embeddings").join(dated, "vec_id", "left")
    old = vectors.where("vec_id % 3 = 0").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    known = old.select(F.concat(F.lit("story-"), F.col("label").cast("string")).alias("story"), F.col("label").alias("rank"), "vector")
    fresh = stories.windows(vectors.where("vec_id % 3 > 0"), "published_at")
    return fresh.withColumn("latest", F.coalesce(-F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(1 << 62))), known


@query("cluster_run")
def cluster_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over each window: its vectors clustered, clusters matched to stories by their first vector, articles assigned."""
    fresh, known = run_parts(spark, sf_dir)
    grouped = stories.clusters(fresh, 0.3, "block", ["latest", "vec_id"], "vec_id", "embedding")
    first = F.min_by("embedding", F.struct("latest", "vec_id")).alias("vector")
    heads = grouped.join(fresh.select("vec_id", "latest", "embedding"), "vec_id").groupBy("block", "cluster").agg(first)
    return grouped.join(stories.matched(heads, known, 0.35), ["block", "cluster"]).select("vec_id", "block", "cluster", "story", "is_new")


# search


@query(
    "index_documents",
    f"WITH {STORE_SQL} SELECT id, title, length(substr(coalesce(content, ''), 1, 5000)) AS indexed, md5(substr(coalesce(content, ''), 1, 300)) AS excerpt, name AS source_name, a.slug, category FROM store a LEFT JOIN source_table s ON s.slug = a.slug",
)
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are indexed: the first 5000 characters, the excerpt, the source's name."""
    docs = search.index_documents(store(spark, sf_dir), source_table(spark, sf_dir))
    return docs.select("id", "title", F.length("content").cast("long").alias("indexed"), F.md5("excerpt").alias("excerpt"), "source_name", "slug", "category")


FIELD = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


@query(
    "index_postings",
    f"""WITH {STORE_SQL}, d AS (SELECT id, title, substr(coalesce(content, ''), 1, 5000) AS content, name AS source_name FROM store a LEFT JOIN source_table s ON s.slug = a.slug),
p AS (SELECT id, 'title' AS field, unnest({FIELD.format('title')}) AS term FROM d UNION ALL SELECT id, 'content', unnest({FIELD.format('content')}) FROM d UNION ALL SELECT id, 'source_name', unnest({FIELD.format('source_name')}) FROM d)
SELECT term, field, count(*) AS tf, count(DISTINCT id) AS df FROM p GROUP BY term, field""",
)
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of three fields, summed by word: an index of two thirds of the documents, upserted with the rest and repeats."""
    docs = search.index_documents(store(spark, sf_dir), source_table(spark, sf_dir))
    fields = ["title", "content", "source_name"]
    index = search.field_postings(docs.where("id % 3 > 0"), fields)
    index = search.reindexed(index, search.field_postings(docs.where("id % 3 < 2"), fields))
    return index.groupBy("term", "field").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


SEARCHED = "der the of"
MATCH_SQL = f"""s AS (SELECT id, published_at, title, language, category, slug, {FIELD.format('content')} AS w FROM store), t AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM s),
h AS (SELECT id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM s, (SELECT unnest(string_split('{SEARCHED}', ' ')) AS term)),
d AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM h GROUP BY term),
b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN d USING (term), t WHERE tf > 0 GROUP BY id)"""


@query("search_filtered", f"WITH {STORE_SQL}, {MATCH_SQL} SELECT id, score, strftime(published_at, '{SQL_STAMP}') AS published_at, title FROM b JOIN s USING (id) WHERE language = 'de' AND category = 'sports' ORDER BY score DESC, s.published_at DESC NULLS LAST, id LIMIT 20")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir).select("id", "language", "category", "slug", "published_at", "title", "content")
    return search.search(rows, SEARCHED, 20, language="de", category="sports", slug=None).select("id", "score", stamp("published_at"), "title")


@query("search_newest", f"WITH {STORE_SQL}, {MATCH_SQL}, m AS (SELECT id, score, s.published_at AS p FROM b JOIN s USING (id) WHERE slug <> 'src4') SELECT id, score, (SELECT count(*) FROM m) AS total FROM m ORDER BY p DESC NULLS LAST, id LIMIT 10")
def search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest matches beside the number of all."""
    rows = store(spark, sf_dir).select("id", "slug", "published_at", "content")
    found = search.matches(rows, SEARCHED).where("slug <> 'src4'")
    page = found.orderBy(F.desc_nulls_last("published_at"), "id").limit(10).select("id", "score")
    return page.crossJoin(found.agg(F.count("*").alias("total")))  # one row


@query("search_indexed_filtered", ORACLE["search_filtered"])
def search_indexed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered search from an index that was written in two parts."""
    index = Index(spark, shared_folder(spark, "index"), shown=("language", "category", "slug", "published_at", "title"))
    rows = store(spark, sf_dir)
    index.write(rows.where("id % 4 > 0"))
    index.upsert(rows.where("id % 4 = 0"))
    return index.search(SEARCHED, 20, language="de", category="sports", slug=None).select("id", "score", stamp("published_at"), "title")


ASK_SQL = """turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), last AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE r BETWEEN 2 AND 7) AS said, max(text) FILTER (WHERE r = 1) AS question FROM turns GROUP BY conv_id)"""


@query("ask_prompts", f"WITH {ASK_SQL} SELECT conv_id, md5('Answer from the numbered sources only.' || chr(10) || CASE WHEN said IS NULL THEN '' ELSE said || chr(10) END || 'user: ' || coalesce(question, '')) AS prompt FROM last")
def ask_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session's model is asked: the instruction, the last six turns before the question, the question."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    turns = load(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(back)).where("r <= 7")
    line = F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, line))), lambda x: x["line"]), "\n")
    asked = turns.groupBy("conv_id").agg(said.alias("said"), F.max(F.when(F.col("r") == 1, F.col("text"))).alias("question"))
    prompt = F.concat_ws("\n", F.lit("Answer from the numbered sources only."), F.nullif("said", F.lit("")), F.concat(F.lit("user: "), F.coalesce("question", F.lit(""))))
    return asked.select("conv_id", F.md5(prompt).alias("prompt"))


