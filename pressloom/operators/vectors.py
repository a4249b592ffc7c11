"""Vectors of texts: hashed TF-IDF, and the pairs of texts that are alike, by built-in functions.

A word's bucket is the number that the first hexadecimal digits of its MD5 are, so there are BUCKETS
at most, whatever the vocabulary, and their document frequencies are a table of
bounded size. Vectors have unit length and are sparse: arrays of (bucket, weight).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.operators.search import run_lengths, terms
from pressloom.session import checkpointed

#: Hexadecimal digits of a word's MD5 that number its bucket, and how many buckets that makes.
DIGITS = 5
BUCKETS = 16**DIGITS
#: Parts of the buckets in which vectors' lengths bound their dot product.
PARTS = 32
#: Dot products are rounded to six digits; bounds are taken as much larger.
SLACK = 1e-6
#: Characters of a content that count beside the title.
LEADING = 200


def embedded_text(title: Column | str = "title", content: Column | str = "content") -> Column:
    """What is embedded of an article: its title, a full stop, and the first LEADING characters of its content."""
    text = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (title, content)]
    return F.concat(text[0], F.lit(". "), F.substring(text[1], 1, LEADING))


def bucket(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, DIGITS), 16, 10).cast("int")


def tf_idf(docs: DataFrame, text: Column, id_col: str = "id") -> DataFrame:
    """(id, vector): array of (bucket, weight) by bucket, of unit length; texts without words have an empty one.

    The weight is a bucket's count in the text times ln((1 + N) / (1 + its documents)) + 1,
    over all N rows of ``docs``, one row an id; words of one bucket count together.
    """
    words = checkpointed(docs.select(F.col(id_col).alias("id"), run_lengths(F.transform(terms(text), bucket), "bucket", "int").alias("b")))
    frequencies = words.select(F.explode("b.bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))
    idf = frequencies.crossJoin(F.broadcast(words.agg(F.count("*").alias("n")))).select("bucket", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    counts = words.select("id", F.inline("b"))
    weighed = counts.join(F.broadcast(idf), "bucket").select("id", "bucket", (F.col("tf") * F.col("idf")).alias("w"))  # at most BUCKETS rows
    lists = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("all"))
    # summed in the buckets' order, so equal texts have vectors equal to the last bit
    lists = lists.withColumn("length", F.sqrt(F.aggregate("all", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    unit = lists.select("id", F.transform("all", lambda x: F.struct(x["bucket"].alias("bucket"), (x["w"] / F.col("length")).alias("weight"))).alias("vector"))
    empty = F.array().cast("array<struct<bucket:int,weight:double>>")
    return words.select("id").join(unit, "id", "left").select("id", F.coalesce("vector", empty).alias("vector"))


def dense(vector: Column, size: int) -> Column:
    """A sparse vector with its buckets added up modulo ``size``, as an array of that many doubles of unit length (or all 0)."""

    def run(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), size))
        kept = lists.drop_null()
        said, ends = kept.flatten(), np.cumsum(kept.value_lengths().to_numpy(zero_copy_only=False).astype(int))
        at = np.searchsorted(ends, np.arange(len(said)), side="right")
        rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))[at]
        np.add.at(out, (rows, said.field("bucket").to_numpy(zero_copy_only=False).astype(int) % size), said.field("weight").to_numpy(zero_copy_only=False))
        length = np.sqrt(np.cumsum(out * out, axis=1)[:, -1:])
        out /= np.where(length > 0, length, 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * size), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<double>")(vector)


def alike(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of ``vectors(id, vector)``: (id, representative) of every row, and (a, b, cosine) of representatives at ``least`` or more, a < b.

    Rows of equal vectors have one representative, the smallest id, so copies make no
    pairs; empty vectors are like nothing. Two unit vectors with a dot product of ``least`` share a bucket
    that is in the prefix of both: rarest buckets first, a vector's prefix ends where what
    is left is shorter than ``least``. Only prefixes are joined, so frequent buckets, which end up in few
    of them, make few candidates; and of these, only those whose weights there and lengths beyond, and whose
    lengths in each of PARTS parts of the buckets allow ``least``, are compared, exactly and where they meet.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity above 0, up to 1")
    some = checkpointed(vectors.where(F.size("vector") > 0).withColumn("_class", F.xxhash64("vector")))
    # equal hashes are told apart by the vectors themselves
    firsts = checkpointed(some.groupBy("_class", "vector").agg(F.min("id").alias("representative")))
    members = some.join(firsts, ["_class", "vector"]).select("id", "representative")
    heads = firsts.select(F.col("representative").alias("id"), "vector")
    frequency = heads.select(F.explode("vector.bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))
    ranked = heads.select("id", F.inline("vector")).join(F.broadcast(frequency), "bucket")  # at most BUCKETS rows
    rest = Window.partitionBy("id").orderBy("df", "bucket").rowsBetween(1, Window.unboundedFollowing)
    # a dot product at an element and after it is at most the product of the lengths from there on
    ranked = ranked.withColumn("after", F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(rest), F.lit(0.0)))
    prefix = ranked.where(F.col("weight") * F.col("weight") + F.col("after") >= least * least - 1e-9)
    prefix = prefix.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "bucket", "weight", F.sqrt("after").alias("rest")))).alias("p"))
    earlier = F.transform("p", lambda x, k: F.struct(x["bucket"].alias("bucket"), x["weight"].alias("weight"), x["rest"].alias("rest"), F.slice("p.bucket", 1, k).alias("earlier")))
    # a part's share of a dot product is at most the product of its lengths, too
    part = lambda g: F.filter("vector", lambda x: x["bucket"] % PARTS == g)
    parts = F.array(*(F.sqrt(F.aggregate(part(g), F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"])) for g in range(PARTS)))
    told = checkpointed(heads.join(prefix, "id").select("id", earlier.alias("prefix"), parts.alias("parts"), F.map_from_entries("vector").alias("v")))
    # vectors go with their prefixes, so a candidate is compared once, at the first bucket that it shares, and never shuffled
    postings = told.select("id", "parts", "v", F.inline("prefix"))
    left, right = (postings.select(F.col("id").alias(c), "bucket", *(F.col(k).alias(f"{k}{c}") for k in ("weight", "rest", "earlier", "parts", "v"))) for c in ("a", "b"))
    beyond = F.col("weighta") * F.col("weightb") + F.col("resta") * F.col("restb")
    met = left.join(right, "bucket").where((F.col("a") < F.col("b")) & (beyond >= least - 1e-9))
    whole = F.aggregate(F.zip_with("partsa", "partsb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, k: s + F.col("va")[k] * F.coalesce(F.try_element_at("vb", k), F.lit(0.0)))
    near = F.when((whole >= least - SLACK) & ~F.arrays_overlap("earliera", "earlierb"), F.round(dot, 6))
    # a filter would take the product twice, and within the join
    pairs = met.select("a", "b", F.explode(F.filter(F.array(near), lambda c: c >= least)).alias("cosine"))
    return members, pairs
