"""The numbered queries over the driver's tables, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import bpe, chat, divergence, lengths, licenses, mix, ogg, quality_rules, resample, shards, simhash, toxicity, weak_quality
from pressloom.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4 differing fingerprint bits or fewer."""
    found = simhash.group_documents(load(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    codec = bpe.ByteBPE(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", codec.encode("text").alias("ids"))
    back = docs.select("doc_id", "ids", codec.decode("ids").alias("decoded"))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as Ogg media, read back with all checks, and described."""
    media = load(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), ogg.store("text").alias("media"))
    return media.select("doc_id", "n_bytes", ogg.read("media").alias("r")).select("doc_id", "n_bytes", "r.*")


#: Weights of the tree's nodes; what is not listed weighs 1. Sources fall into four domains by number.
MIX_WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 2, ("other",): 1} | {
    (d, lang): w for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 5), ("de", 3), ("fr", 2), ("es", 2))
}


def domain_of(source: str) -> Column:
    """The stand-in domain of a source: d0 to d3 by its number, else other."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("long")
    return F.when(number.isNull(), "other").otherwise(F.concat(F.lit("d"), (number % 4).cast("string")))


@query
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tenths of all words by weight, at most two epochs of a source: how often each selected document is taken."""
    docs = load(spark, sf_dir, "documents")
    found = mix.select(docs, domain_of("source"), MIX_WEIGHTS, fraction=0.6, epochs=2)
    return found.select("doc_id", "_mix.*")


@query
def op8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of the encoded lengths of all documents, with its suffix sums for every context limit."""
    docs = load(spark, sf_dir, "documents").select(bpe.ByteBPE(spark).count("text").alias("n"))
    return lengths.context_limits(lengths.histogram(docs, F.col("n")))


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted in windows and read back."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], turns.schema)
    made = chat.windows(turns.unionByName(odd), bpe.ByteBPE(spark).count("text"), budget=2048, history=512)
    return chat.digests(made)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the threshold table's verdict of every document."""
    found = quality_rules.metrics(load(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col("_counts")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    judged = found.select("doc_id", *counts, quality_rules.base_failed().alias("base_failed"), quality_rules.verdict().alias("verdict"))
    return judged.select("doc_id", *QUALITY_COLUMNS, "base_failed", (~F.col("base_failed") & F.col("verdict")).alias("kept"))


QUALITY_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(" ".join(quality_rules.STOP_WORDS.values()).split())))
    ratio = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END BETWEEN {2} AND {3}"
    rules = " AND ".join(ratio.format(r.top, r.bottom, r.low, r.high) for r in quality_rules.RULES)
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
c AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM w),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
f AS (SELECT c.*, coalesce(p.n, 0) AS n_repeat_words FROM c LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept
FROM b"""


ORACLE["op5_quality_rules"] = quality_sql()


def mix_sql() -> str:
    weights = ", ".join(f"('{chr(31).join(k)}', {w})" for k, w in MIX_WEIGHTS.items())

    def level(name: str, above: str, path: str, own: str) -> str:
        """One level's water-filling; ``path`` is what identifies the parent, ``own`` the child."""
        key = f"{path}, {own}" if path else own
        part = f"PARTITION BY {path}" if path else "PARTITION BY 1"
        text = " || chr(31) || ".join(key.split(", "))
        join = f"JOIN {above} USING ({path})" if path else f", {above}"
        return f"""
{name}0 AS (SELECT {key}, sum(tokens) * 2 AS cap, sum(tokens) AS tokens FROM leaf GROUP BY {key}),
{name}1 AS (SELECT {name}0.*, budget, coalesce(weight, 1) AS weight FROM {name}0 {join} LEFT JOIN spec ON spec.path = {text}),
{name}2 AS (SELECT *, cap * sum(weight) OVER ({part} ORDER BY cap / weight, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM {name}1),
{name}3 AS (SELECT *, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS open_total,
    budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS rest,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part} ORDER BY {own} ROWS UNBOUNDED PRECEDING) AS upto FROM {name}2),
{name} AS (SELECT {key}, tokens, CASE WHEN is_full THEN cap ELSE (upto * rest) // open_total - ((upto - weight) * rest) // open_total END AS budget FROM {name}3)"""

    return f"""
WITH spec AS (SELECT * FROM (VALUES {weights}) AS v(path, weight)),
doc AS (
  SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4), 'other') AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM doc WHERE n_tokens > 0 GROUP BY ALL),
root AS (SELECT least(floor(sum(tokens) * 0.6::DOUBLE)::BIGINT, sum(tokens) * 2) AS budget FROM leaf),
{level("l1", "root", "", "domain")},
{level("l2", "l1x", "domain", "lang").replace("l20 AS", "l1x AS (SELECT domain, budget FROM l1)," + chr(10) + "l20 AS", 1)},
{level("l3", "l2x", "domain, lang", "source").replace("l30 AS", "l2x AS (SELECT domain, lang, budget FROM l2)," + chr(10) + "l30 AS", 1)},
cut AS (SELECT domain, lang, source, (budget // tokens)::BIGINT AS epoch, (budget % tokens)::BIGINT AS rest FROM l3),
placed AS (SELECT doc.*, epoch, rest, md5('42|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS place
           FROM doc JOIN cut USING (domain, lang, source) WHERE n_tokens > 0),
taken AS (SELECT *, epoch + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, copies::BIGINT AS copies FROM taken WHERE copies > 0"""


ORACLE["op6_mix"] = mix_sql()


@query
def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and decision of every document, from weak labels alone."""
    return weak_quality.classify(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and decision of every document, from the labelled ones."""
    docs = load(spark, sf_dir, "documents")
    grader = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return grader.grade(docs.select("doc_id", "text")).select("doc_id", "_toxicity.*")


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence template that a document holds."""
    return licenses.scan(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document when five of a hundred are drawn towards the benchmark's n-grams."""
    found = resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all sources of a language, and the terms each uses more than its language."""
    return divergence.audit(load(spark, sf_dir, "documents"))


ORACLE["op12_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM f JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL) JOIN v USING (lang)),
a AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
t AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM a
      UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM t)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""


@query
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in one seeded order of all, eight shards."""
    return shards.assigned(load(spark, sf_dir, "documents"), n_shards=8).withColumnRenamed("id", "doc_id")
