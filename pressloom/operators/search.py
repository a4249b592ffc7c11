"""Full-text search with BM25 over an inverted index, and the context for answers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.session import checkpointed

K1, B = 1.2, 0.75
#: Characters of a content that are indexed, and of an excerpt.
INDEXED, EXCERPT = 5000, 300
CONTEXT_CHARS = 6000


def terms(text):
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def _let(value, then):
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def run_lengths(values, name: str, kind: str):
    """The distinct elements of an array as (name, tf) in order, within the row: sorted, then cut where the element changes."""

    def runs(s):
        size = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        cut = lambda p: F.transform(p, lambda x, k: F.struct(F.get(s, x).alias(name), (F.coalesce(F.get(p, k + 1), size) - x).alias("tf")))
        return F.when(size > 0, _let(starts, cut)).otherwise(F.array().cast(f"array<struct<{name}:{kind},tf:int>>"))

    return _let(F.sort_array(values), runs)


def _is(word: str):
    return lambda x: x == word


def index_documents(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """What the index holds of articles(id, title, content, ...) and sources(slug, name): INDEXED characters of content, the excerpt, the source's name."""
    named = sources.select("slug", F.col("name").alias("source_name"))
    content = F.coalesce("content", F.lit(""))
    return articles.join(F.broadcast(named), "slug", "left").withColumns(  # one row a source
        {"excerpt": F.substring(content, 1, EXCERPT), "content": F.substring(content, 1, INDEXED)}
    )


def field_postings(documents: DataFrame, fields: list[str]) -> DataFrame:
    """(term, field, id, tf) of the searchable fields: the inverted index, one row per word, field and document."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("w")) for f in fields)))
    words = documents.select("id", each.alias("f")).select("id", "f.field", F.explode("f.w").alias("term"))
    return words.groupBy("term", "field", "id").agg(F.count("*").alias("tf"))


def reindexed(index: DataFrame, changed: DataFrame) -> DataFrame:
    """``index`` with the postings of ``changed`` in place of those of the same documents."""
    return index.join(changed.select("id").distinct(), "id", "left_anti").select(*index.columns).unionByName(changed.select(*index.columns))


def index_size(articles: DataFrame) -> DataFrame:
    """One row of tokens, terms and documents; whole contents are read once, only each text's distinct words are shuffled."""
    one = articles.select(_let(terms("content"), lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(w).alias("w"))).alias("t")).select("t.*")
    total = one.agg(F.sum("n").cast("long").alias("tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("documents"))
    distinct = one.select(F.explode("w").alias("term")).distinct().agg(F.count("*").alias("terms"))
    return total.crossJoin(distinct).select("tokens", "terms", "documents")  # one row each


def postings(articles: DataFrame) -> DataFrame:
    """(term, id, tf): one row per word and article over whole contents."""
    return articles.select("id", F.explode(terms("content")).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def matches(articles: DataFrame, query: str) -> DataFrame:
    """``articles`` without content, with ``score``: BM25 of every article that holds a word of the query.

    Texts are read once, to their length and their counts of the query's words, which
    are written; statistics and scores come from these narrow rows. Statistics cover all articles.
    """
    wanted = sorted(set(query.lower().split())) or [""]
    counts = lambda w: F.struct(F.size(w).alias("len"), F.array(*(F.size(F.filter(w, _is(t))) for t in wanted)).alias("tf"))
    narrow = checkpointed(articles.withColumn("_t", _let(terms("content"), counts)).drop("content"))
    df = F.array(*(F.count(F.when(F.col("_t.tf")[k] > 0, 1)) for k in range(len(wanted))))
    whole = narrow.agg(F.count("*").alias("_n"), F.avg("_t.len").alias("_mean"), df.alias("_df"))
    found = narrow.where(F.exists("_t.tf", lambda x: x > 0)).crossJoin(F.broadcast(whole))  # one row of statistics

    def part(k: int):
        tf, d = F.col("_t.tf")[k], F.col("_df")[k]
        idf = F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_t.len") / F.col("_mean")))).otherwise(0.0)

    return found.withColumn("score", F.round(sum((part(k) for k in range(len(wanted))), F.lit(0.0)), 6)).drop("_t", "_n", "_mean", "_df")


def search(articles: DataFrame, query: str, limit: int, **equal: str | None) -> DataFrame:
    """(id, score, published_at, title), the best ``limit``: BM25, then the newest, then the id.

    ``equal`` are filters on columns, all of which must hold; they leave hits out, not
    articles of the statistics. Null asks nothing.
    """
    found = matches(articles, query)
    for column, value in equal.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    return found.select("id", "score", "published_at", "title").orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "id").limit(limit)


def highlighted(text: str, query: str):
    """A text with <em> around the words of a query, whatever characters they have; a query without words changes nothing."""
    edge = lambda c: r"\b" if c.isalnum() or c == "_" else ""
    words = [edge(w[0]) + re.sub(r"([^\w])", r"\\\1", w) + edge(w[-1]) for w in sorted(set(query.lower().split()), key=lambda w: (-len(w), w))]
    return F.regexp_replace(F.col(text), F.lit(f"(?i)({'|'.join(words)})"), F.lit("<em>$1</em>")) if words else F.col(text)


def context_part(rank, title, source, published, excerpt):
    """A hit as a part of an answer's context: [1] title (source, day)\\nexcerpt\\n."""
    or_else = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    day = F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit("n/d"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), or_else(title, "Untitled"), F.lit(" ("), or_else(source, "unknown"), F.lit(", "), day, F.lit(")\n"), F.coalesce(excerpt, F.lit("")), F.lit("\n"))


def context(hits: DataFrame, rank: str, part: str, key: list[str], most: int = CONTEXT_CHARS) -> DataFrame:
    """The leading hits of each key whose parts, each followed by a line end, stay within ``most``; stops at the first that does not.

    A part takes a character at least, so no more than the first most + 1 hits of a key are
    summed; give fewer hits a key where there are many, as a search's limit does.
    """
    order = Window.partitionBy(*key).orderBy(rank)
    some = hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most + 1)
    sized = some.withColumn("_sum", F.sum(F.length(part) + 1).over(order))
    fits = F.col("_sum") - 1 <= most
    return sized.withColumn("_bad", F.max((~fits).cast("int")).over(order)).where("_bad = 0").drop("_sum", "_bad", "_rank")


def last_turns(turns: DataFrame, k: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return turns.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_rank") <= k).drop("_rank")
