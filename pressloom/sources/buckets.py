"""Keyed Parquet tables in hash buckets, of which a change rewrites only those it touches.

A table is partitioned by the bucket of its key. An upsert finds the changes' buckets,
reads those alone, and writes them again with dynamic partition overwrite, so its cost
follows the changes and not the table. A change applied twice leaves the same rows, so a
batch that is run again after a failure does no harm. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.operators import dedup
from pressloom.session import checkpointed

BUCKET = "_bucket"
#: False in the row that keeps the place of a bucket without other rows, so that it is overwritten too.
LIVE = "_live"


@dataclass(frozen=True)
class Buckets:
    """The table at ``path``, one row a ``key``, in ``n`` buckets; path, key and n stay the same for its whole life."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    n: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n)).cast("int")

    def _typed(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Columns in the table's types: a key's bucket depends on its type."""
        return rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in names))

    def _rows(self) -> DataFrame:
        kind = T.StructType([*self.schema.fields, T.StructField(LIVE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(kind).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        """The table's rows; none if nothing was ever written."""
        return self._rows().where(LIVE).select(*self.schema.names)

    def of_keys(self, keys: list) -> DataFrame:
        """The rows of a few keys; only their buckets are read."""
        places = self.spark.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, keys)), lambda k: F.pmod(F.xxhash64(k.cast(self.schema[self.key].dataType)), F.lit(self.n)).cast("int"))).alias("b")).first().b if keys else []
        return self._rows().where(F.col(BUCKET).isin(places) & F.col(LIVE) & F.col(self.key).isin(keys)).select(*self.schema.names)

    def _put(self, change, touching: DataFrame) -> int:
        """Rewrites the buckets of the keys of ``touching`` as ``change`` makes them of their rows; how many there were."""
        # at most n numbers: they become the scan's partition filter
        touched = sorted(r[0] for r in touching.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect())
        if touched:
            old = self._rows().where(F.col(BUCKET).isin(touched) & F.col(LIVE)).select(*self.schema.names)
            rows = change(old).select(*self.schema.names).withColumns({LIVE: F.lit(True), BUCKET: self.bucket()})
            holders = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").withColumn(LIVE, F.lit(False))
            every = rows.unionByName(holders, allowMissingColumns=True)
            every.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return len(touched)

    def upsert(self, changes: DataFrame, newest: str | None = None) -> int:
        """Puts ``changes``, one row a key, in place of the rows with their keys; rows without a key go. Returns the number of buckets rewritten.

        With ``newest``, a column that grows with time, a row that is there stays where it is
        newer than the change, so changes may come late or in any order.
        """
        changes = checkpointed(self._typed(changes, self.schema.names).where(F.col(self.key).isNotNull()))

        def change(old: DataFrame) -> DataFrame:
            if newest is None:
                return dedup.upserted(old, changes, self.key)
            late = old.select(self.key, F.col(newest).alias("_held")).join(changes.select(self.key, newest), self.key).where(F.col("_held") > F.col(newest)).select(self.key)
            return dedup.upserted(old, changes.join(late, self.key, "left_anti"), self.key)

        return self._put(change, changes)

    def insert(self, rows: DataFrame, order: list[str]) -> int:
        """Adds the first row, by ``order``, of every key that the table lacks; what is there stays."""
        rows = checkpointed(self._typed(rows, self.schema.names))
        return self._put(lambda old: dedup.inserted(old, rows, self.key, order), rows)

    def delete(self, keys: DataFrame) -> int:
        """Takes out the rows of the keys that ``keys`` has under the table's key name."""
        keys = checkpointed(self._typed(keys, [self.key]))
        return self._put(lambda old: old.join(keys, self.key, "left_anti"), keys)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
