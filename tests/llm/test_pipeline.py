"""Every pipeline stage against what its operator decides alone."""

import corpus_pipeline
from llm_support import docs_of
from pyspark.sql import functions as F

from pressloom.llm import mix, quality_rules, simhash, toxicity
from pressloom.llm.catalog import MIX_WEIGHTS, domain_of

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "source_mixing", "byte_level_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    alone = [
        lambda d: toxicity.train(d, labels).grade(d).where("not _toxicity.toxic"),
        lambda d: quality_rules.metrics(d).where(~quality_rules.base_failed() & quality_rules.verdict()),
        lambda d: d.join(simhash.group_documents(d, words=5, similar=True).where(F.col("id") == F.col("component_id")).select(F.col("id").alias("doc_id")), "doc_id", "left_semi"),
        lambda d: mix.select(d, domain_of("source"), MIX_WEIGHTS, fraction=0.9, epochs=1),
    ]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert kept.columns == docs.columns and ids(kept) == ids(alone[k](docs)) and 0 < kept.count() <= docs.count()
        else:
            assert ids(kept) == ids(docs) and kept.where("not round_trip or n_tokens <> size(ids)").count() == 0
        docs = kept
    assert ids(corpus_pipeline.run(spark, SF)) == ids(docs)


def test_empty_documents(spark):
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_and_extra_columns_go_through_every_stage(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns named like the stages' own."""
    words = lambda k, n=80: " ".join(f"the w{k}x{i} of" for i in range(n))
    rows = [(k, words(k), "en", f"src{k % 3}", 1) for k in range(30)]
    rows += [(1, words(1), "en", "src1", 1)] * 3 + [(40 + k, words(5), "en", "src2", 1) for k in range(4)]
    rows += [(None, None, None, None, None), (50, None, "en", "src1", None), (None, words(51), None, None, None), (52, "", "en", "src1", 0), (53, "x" * 200_000, "en", "src1", 1), (54, words(54, 40_000), "en", "src0", 1)]
    docs = docs_of(spark, []).sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["_score", "_toxicity", "_counts", "_w_words", "_near_id", "_NEAR_HASH", "_mix", "_leaf", "_cut", "_copy", "fp", "n", "words", "ids", "id", "a.b"]
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    columns, kept = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert docs.where(" or ".join(f"`{n}` <> concat('{n}', coalesce(cast(doc_id as string), 'none'))" for n in names)).count() == 0
    # empty texts and the text of one word go by quality, copies by near-dedup
    assert kept[1] == len(rows) and kept[2] == len(rows) - 4 and kept[3] == 32 and 0 < kept[4] <= 32 and kept[5] == kept[4]
    assert docs.where("not round_trip").count() == 0
