"""Two-pass shuffled shards: every row once, balanced, gapless, seeded, well mixed."""

from collections import Counter
from zlib import crc32

from llm_support import ODD, SF, docs_of
from pyspark.sql import functions as F

from pressloom.llm import catalog, shards


def check(rows, texts, n_shards):
    """Contract of the result: rows of (id, size, crc, shard, slot) against the (id, text)s given."""
    want = Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in texts)
    assert Counter(r[:3] for r in rows) == want
    counts = Counter(r[3] for r in rows)
    sizes = [counts.get(k, 0) for k in range(n_shards)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    for k in range(n_shards):
        assert sorted(r[4] for r in rows if r[3] == k) == list(range(sizes[k]))


def rows_of(df):
    return [tuple(r) for r in df.select(df.columns[0], "size", "text_crc32", "shard", "slot").collect()]


def test_query_places_every_document(spark, real):
    df = catalog.QUERIES["op13_shards"](spark, SF)
    rows = df.collect()
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    check([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows], [(r.doc_id, r.text) for r in real.collect()], 8)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows_in_many_buckets(spark):
    texts = [*ODD, *("t" * k for k in range(150))]
    ids = [None, None, *range(len(texts) - 4), 3, 3]
    docs = docs_of(spark, texts, ids=ids).withColumnsRenamed({"n_chars": "bucket", "lang": "_hash"})
    for n_shards, size in ((8, 640), (7, 1 << 20), (1000, 64)):
        check(rows_of(shards.assigned(docs, n_shards, bucket_bytes=size)), list(zip(ids, texts, strict=True)), n_shards)
    assert shards.assigned(docs_of(spark, [])).count() == 0


def test_seeded_and_mixed(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    order = lambda seed: [r.doc_id for r in shards.shuffled(docs, F.lit(64), seed=seed, bucket_bytes=64 * 500).orderBy("_place.position").collect()]
    first = order(1)
    assert first == order(1) and first != order(2) and sorted(first) == list(range(4000))
    # neighbours in the input are no neighbours in the order, and no part of the order prefers low ids
    at = {x: k for k, x in enumerate(first)}
    assert sum(abs(at[i] - at[i + 1]) < 40 for i in range(3999)) < 200
    assert all(abs(sum(first[k : k + 500]) / 500 - 2000) < 260 for k in range(0, 4000, 500))


def test_permutation_within_a_bucket_is_uniform(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"))
    seen = Counter(tuple(r.doc_id for r in shards.shuffled(docs, F.lit(64), seed=s).orderBy("_place.position").collect()) for s in range(40))
    assert len(seen) == 6


def test_one_id_that_fills_a_bucket(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    placed = shards.shuffled(docs, F.lit(64), bucket_bytes=64 * 100)
    counts = placed.groupBy("_place.bucket").count().agg(F.max("count"), F.count("*")).first()
    assert counts[0] < 400 and counts[1] == 30
    assert sorted(int(r.text) for r in placed.collect()) == list(range(3000))


def test_files_hold_whole_rows_in_order(spark, tmp_path):
    texts = [*ODD, *("word " * k for k in range(300))]
    docs = docs_of(spark, texts).withColumnRenamed("lang", "_shard")
    shards.write(docs, f"{tmp_path}/out", n_shards=5, bucket_bytes=20_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    rows = [(r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode()), r["_shard"], r["_slot"]) for r in back.collect()]
    check(rows, list(enumerate(texts)), 5)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
    files = back.withColumn("file", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    for a, b in zip(files, files[1:], strict=False):
        assert a.file != b.file or a["_slot"] < b["_slot"]
