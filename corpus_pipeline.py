"""The training-data pipeline: stages applied in turn to ``documents``.

Each stage reads what its predecessor kept, whole, and its decision takes effect. All
but the last return the columns of ``documents``; ``run`` writes what a stage kept to
the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import bpe, mix, quality_rules, simhash, toxicity
from pressloom.llm.catalog import MIX_WEIGHTS, domain_of
from pressloom.session import checkpointed, load

#: SQL cannot express the fitted grader and the encoder; tests hold the stages against brute-force versions.
ORACLE_SQL = None
#: Share of all words that the mixture takes; no document is taken twice.
MIX_FRACTION = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the grader, fitted on the labelled ones, finds toxic go."""
    return toxicity.clean(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that break a base rule or the threshold table go."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each near-duplicate group stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that their source's budget does not reach go."""
    return mix.take(docs, domain_of("source"), MIX_WEIGHTS, fraction=MIX_FRACTION, epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the ids of every text, and whether they decode to it."""
    codec = bpe.ByteBPE(spark)
    with_ids = docs.select("doc_id", "lang", "source", "text", codec.encode("text").alias("ids"))
    return with_ids.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (codec.decode("ids") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else checkpointed(docs), sf_dir)
    return docs
