"""Keyed tables in buckets, and search from a stored index against a scan of all texts."""

import os

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressloom.operators import indexed, search
from pressloom.operators.indexed import Index, term_counts, word_hash
from pressloom.plans import catalog
from pressloom.sources.adapter import articles
from pressloom.sources.buckets import Buckets

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def written(folder):
    """When each file below a folder was written."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet")}


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/t", "k", StructType.fromDDL("k long, v string"), 16)
    assert table.read().count() == 0 and table.upsert(spark.createDataFrame([], table.schema)) == 0
    assert table.upsert(spark.range(200).selectExpr("id as k", "'old' as v")) == 16
    before = written(f"{tmp_path}/t")
    changes = spark.createDataFrame([(5, "new"), (6, None), (1000, "more"), (None, "no key")], table.schema)
    touched = {r[0] for r in changes.where("k is not null").select(table.bucket()).collect()}
    for _ in range(2):
        assert table.upsert(changes) == len(touched) < 4
        after = written(f"{tmp_path}/t")
        assert {p.split("_bucket=")[1].split("/")[0] for p in after.keys() - before.keys()} == {str(b) for b in touched}
        assert all(before[p] == after[p] for p in before.keys() & after.keys())
        wanted = [(k, {5: "new", 6: None}.get(k, "old")) for k in range(200)] + [(1000, "more")]
        assert rows_of(table.read()) == sorted(wanted, key=repr)
    plan = table.of_keys([5, 1000])
    assert rows_of(plan) == [(1000, "more"), (5, "new")] and "_bucket" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert table.insert(spark.createDataFrame([(5, "late"), (2000, "b"), (2000, "a")], table.schema), ["v"]) == len({r[0] for r in spark.createDataFrame([(5,), (2000,)], "k long").select(table.bucket()).collect()})
    assert rows_of(table.of_keys([5, 2000])) == [(2000, "a"), (5, "new")]


def test_keys_of_another_type_meet_the_same_rows(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/t", "k", StructType.fromDDL("k long, v string"), 8)
    table.upsert(spark.range(50).selectExpr("id as k", "'old' as v"))
    table.upsert(spark.createDataFrame([(k, "new") for k in (1, 2, 3)], "k int, v string"))
    table.insert(spark.createDataFrame([(4, "late"), (60, "x")], "k int, v string"), ["v"])
    table.delete(spark.createDataFrame([(7,), (8,)], "k int"))
    assert rows_of(table.read()) == sorted([(k, "new" if k in (1, 2, 3) else "old") for k in range(50) if k not in (7, 8)] + [(60, "x")], key=repr)
    made = Index(spark, f"{tmp_path}/i", doc_buckets=8)
    made.write(spark.range(40).selectExpr("id", "concat('word w', id) as content"))
    made.upsert(spark.createDataFrame([(3, "other"), (99, "word")], "id int, content string"))
    assert sorted(r.id for r in made._scored(["word"], "content", lambda tf, _: F.col(tf), None).collect()) == [k for k in range(40) if k != 3] + [99]


def test_deletes_empty_a_bucket_and_late_changes_lose(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/t", "k", StructType.fromDDL("k long, at int"), 4)
    table.upsert(spark.range(4).selectExpr("id as k", "10 as at"))
    table.delete(spark.range(4).selectExpr("id as k"))
    assert rows_of(table.read()) == []
    table.upsert(spark.createDataFrame([(1, 5), (2, 5)], table.schema), newest="at")
    table.upsert(spark.createDataFrame([(1, 4), (2, 6), (3, 1)], table.schema), newest="at")
    assert rows_of(table.read()) == [(1, 5), (2, 6), (3, 1)]


def test_words_are_counted_within_the_row(spark):
    rows = spark.createDataFrame([("b a B c1 a a",), ("",), (None,), ("?!",)], "t string")
    found = [r.c for r in rows.select(term_counts(F.col("t")).alias("c")).collect()]
    hashed = {w: spark.range(1).select(word_hash(F.lit(w))).first()[0] for w in ("a", "b", "c1")}
    assert [(c.len, [tuple(w) for w in c.words]) for c in found] == [(6, sorted([(hashed["a"], 3), (hashed["b"], 2), (hashed["c1"], 1)])), (0, []), (0, []), (0, [])]


def index_of(spark, rows, folder, **options):
    made = Index(spark, folder, shown=("title", "language", "published_at"), **options)
    made.write(rows)
    return made


def test_search_equals_the_scan_and_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexed, "FREQUENT", 20)
    rows = articles(spark, SF)
    made = index_of(spark, rows, f"{tmp_path}/i", blocks=8)
    shown = ["id", "score", "published_at", "title"]
    for query, limit, language in (("nation the eine clown", 20, None), ("clown", 5, None), ("der the of", 3, "de"), ("der der THE", 10**6, None), ("nosuchword", 5, None), ("", 5, None)):
        wanted = [tuple(r) for r in search.search(rows, query, limit, language=language).select(shown).collect()]
        assert [tuple(r) for r in made.search(query, limit, language=language).select(shown).collect()] == wanted
        assert rows_of(made.matches(query).select("id", "score")) == rows_of(search.matches(rows, query).select("id", "score"))
    seen, every = made.considered("nation the eine clown", 5)
    assert 0 < seen < every / 2
    plan = made.matches("clown")._jdf.queryExecution().executedPlan().toString()
    assert any("term_bucket" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def test_buckets_are_written_by_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    rows = articles(spark, SF)
    whole = index_of(spark, rows, f"{tmp_path}/i", term_buckets=1, doc_buckets=1)
    monkeypatch.setattr(indexed, "TASK", 20000)
    made = index_of(spark, rows.where("id % 2 = 0"), f"{tmp_path}/j", term_buckets=1, doc_buckets=1)
    made.upsert(rows.where("id % 2 = 1"))
    counts = [r[0] for r in made.table("postings").groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(counts) > 5 and max(counts) < sum(counts) / 2  # one file before
    for name in ("postings", "heads", "documents", "sizes"):
        columns = made.table(name).columns
        assert rows_of(made.table(name)) == rows_of(whole.table(name).select(columns))


def test_changed_documents_rewrite_their_buckets_alone(spark, tmp_path):
    rows = articles(spark, SF).where("id < 400")
    made = index_of(spark, rows.where("id % 3 > 0"), f"{tmp_path}/i", doc_buckets=8)
    stale = rows.where("id % 50 = 7").withColumn("content", F.lit("only these words now"))
    made.upsert(stale)
    made.upsert(rows.where("id % 3 = 0 or id % 50 = 7"))
    before = written(f"{tmp_path}/i")
    for _ in range(2):
        assert made.upsert(rows.where("id in (7, 8)")) <= 2
    after = written(f"{tmp_path}/i")
    assert len({p.split("doc_bucket=")[1].split("/")[0] for p in after.keys() - before.keys()}) <= 2
    fresh = index_of(spark, rows, f"{tmp_path}/j", doc_buckets=8)
    for query in ("clown the", "only these words", "nation of"):
        assert rows_of(made.matches(query)) == rows_of(fresh.matches(query))
    only = rows.where("id = 7").withColumn("content", F.lit(None).cast("string"))
    made.upsert(only)
    assert made.matches("the of der").where("id = 7").count() == 0
    assert made.table("sizes").agg(F.sum("n")).first()[0] == rows.count()


def test_queries_of_the_index(spark):
    """The registered queries give what the scans give, on a second size of the tables."""
    for name, other in (("search_indexed", "search_bm25"), ("search_indexed_filtered", "search_filtered")):
        assert [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()] == [tuple(r) for r in catalog.QUERIES[other](spark, SF).collect()]
