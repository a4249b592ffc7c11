"""Snapshots of tables as Parquet folders by name and time, their listing, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def push(tables: dict[str, DataFrame], folder: str, now: str, label: str | None = None) -> str:
    """Writes tables below folder/store[-label]-YYYYMMDD-HHMMSS, one folder a table; returns that folder."""
    stamp = now.replace("-", "").replace(":", "").replace(" ", "-")
    target = f"{folder}/store{'-' + label if label else ''}-{stamp}"
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{target}/{name}.parquet")
    return target


def listing(spark: SparkSession, folder: str, limit: int = 50) -> DataFrame:
    """(snapshot, table, modified, mb): what is stored, the latest first; derived index tables are of the type index, others store.

    Paths and sizes come from the file listing; contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "modificationTime", "length")
    part = lambda k: F.regexp_extract("path", r"/([^/]*-\d{8}-\d{6})/([^/]+)\.parquet/[^/]+$", k)
    found = files.select(part(1).alias("snapshot"), part(2).alias("table"), "modificationTime", "length").where("snapshot <> ''")
    sized = found.groupBy("snapshot", "table").agg(F.max("modificationTime").alias("modified"), F.round(F.sum("length") / (1 << 20), 1).alias("mb"))
    kind = F.when(F.startswith("table", F.lit("index_")), "index").otherwise("store")
    return sized.withColumn("type", kind).orderBy(F.desc("modified"), "snapshot", "table").limit(limit)


def latest(spark: SparkSession, folder: str, label: str | None = None) -> str | None:
    """The newest snapshot's name, of a label if one is given, by the time in its name; null without any."""
    names = listing(spark, folder, 1 << 30).select("snapshot").distinct()
    if label:
        names = names.where(F.startswith("snapshot", F.lit(f"store-{label}-")))
    return names.agg(F.max(F.struct(F.regexp_extract("snapshot", r"(\d{8}-\d{6})$", 1).alias("at"), "snapshot"))["snapshot"].alias("s")).first().s


def pull(spark: SparkSession, folder: str, name: str, snapshot: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{snapshot}/{name}.parquet")


def to_csv(rows: DataFrame, folder: str) -> None:
    """Small reports as one CSV file with a header; rows are to be few, such as one per source and day."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def replaced(rows: DataFrame, folder: str) -> None:
    """A table written in place of what is there."""
    rows.write.mode("overwrite").parquet(folder)
