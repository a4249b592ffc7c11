"""Shuffled shards by a two-pass external shuffle, built-in functions only.

The first pass scatters records uniformly by a seeded hash into buckets that fit a
task's memory: Spark's own shuffle deals one bucket to one partition and spills what
it must. The second pass takes a bucket as one array, permutes it by Fisher-Yates
(the built-in ``shuffle``, seeded by bucket) and gives its records out again in that
order. The buckets one after the other are one uniform order of all records, and shards are
ranges of it, of which no two differ by more than one record.

What is gathered in one place is one bucket's records; only numbers of records by
bucket pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.texts import free_name, own
from pressloom.session import checkpointed

LAW = "rows"
#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 32 << 20
#: A bucket of more than so many times that holds a repeated id or a very large record.
CROWDED = 4
#: Bytes that a record takes beside its text.
ROW_BYTES = 64


def shuffled(rows: DataFrame, row_bytes: Column, id_col: str = "doc_id", seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` in a seeded uniform order, with a struct ``_place`` of bucket (int), position (long, gapless from 0) and total (long).

    ``row_bytes`` says how much memory a row takes. The same rows, seed and bucket
    size give the same order, but for rows that are equal in their id, which may change
    places. Null ids are an id like any other; where an id repeats so often that
    a bucket is crowded, the rows are written once and scattered by their number too.
    Columns stay whatever their names, but for one named ``_place``, which is replaced.
    """
    hash_name, bucket_name = free_name(rows, "_hash"), free_name(rows, "_bucket")
    scattered = F.xxhash64(F.lit(seed), F.coalesce(own(id_col).cast("string"), F.lit("")))

    def filled(keyed: DataFrame) -> tuple[DataFrame, int, DataFrame, int, int]:
        narrow = checkpointed(keyed.select(F.col(hash_name).alias("hash"), row_bytes.cast("long").alias("bytes")))
        total, size = narrow.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        buckets = max(1, -(-size // bucket_bytes))
        fill = narrow.groupBy(F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        fill = checkpointed(fill)
        return keyed, buckets, fill, total, fill.agg(F.max("bytes")).first()[0] or 0

    keyed, buckets, fill, total, most = filled(rows.drop("_place").withColumn(hash_name, scattered))
    if most > CROWDED * bucket_bytes:
        keyed = checkpointed(keyed.withColumn(hash_name, F.xxhash64(F.col(hash_name), F.monotonically_increasing_id())))
        keyed, buckets, fill, total, most = filled(keyed)
    keyed = keyed.withColumn(bucket_name, F.pmod(hash_name, F.lit(buckets)).cast("int"))
    # one partition a bucket; a fixed order before the permutation, so that it depends on the seed alone
    dealt = keyed.repartitionById(buckets, F.col(bucket_name)).sortWithinPartitions(hash_name, own(id_col))
    kept = [own(c).alias(c) for c in rows.drop("_place").columns]
    arrays = dealt.groupBy(bucket_name).agg(F.collect_list(F.struct(*kept)).alias("rows"))
    permuted = arrays.select(F.col(bucket_name).alias("bucket"), F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = fill.select("bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.struct("bucket", (F.col("before") + F.col("at")).alias("position"), F.lit(total).cast("long").alias("total"))
    return permuted.join(before, "bucket").select("row.*", place.alias("_place"))


def shard_of(n_shards: int, place: str = "_place") -> tuple[Column, Column]:
    """(shard, slot): ranges of the order, no two of which differ by more than one row."""
    position, total = F.col(place)["position"], F.col(place)["total"]
    shard = F.call_function("div", position * n_shards, total)
    return shard.cast("int"), position - F.call_function("div", shard * total + (n_shards - 1), F.lit(n_shards).cast("long"))


def text_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes of a text, none where it is null."""
    return F.coalesce(F.octet_length(own(text_col)), F.lit(0)).cast("long")


def write(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 42, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, **options) -> None:
    """``docs`` as Parquet below ``path``/_shard=k, in the order of ``_slot``: each bucket is written by one task, whole texts are shuffled once.

    All columns stay but ones named _shard or _slot, which are replaced; a table without rows writes none.
    """
    placed = shuffled(docs, text_bytes(text_col) + ROW_BYTES, seed=seed, bucket_bytes=bucket_bytes, **options)
    shard, slot = shard_of(n_shards)
    placed = placed.withColumns({"_shard": shard, "_slot": slot}).drop("_place")
    placed.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def assigned(docs: DataFrame, n_shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, bucket): where every row of ``docs`` goes; its texts are read once and not shuffled.

    size is the text's bytes plus one. Null and empty texts have none and a CRC of 0. The law is that shards'
    numbers of rows are at most one apart; more shards are another cut of the same order, so
    grown_shard is null. Repeated rows have places of their own; an empty table gives no rows.
    """
    text = F.coalesce(own(text_col).cast("string"), F.lit(""))
    narrow = checkpointed(docs.select(own(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    shard, slot = shard_of(n_shards)
    return shuffled(narrow, F.lit(ROW_BYTES), "id", seed, bucket_bytes).select(
        "id", "size", "text_crc32", F.lit(LAW).alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_place")["bucket"].alias("bucket")
    )
