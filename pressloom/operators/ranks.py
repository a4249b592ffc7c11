"""Gapless numbers in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.session import checkpointed


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with a gapless long ``out`` from 1 in ``order``, which may leave ties.

    Rows are dealt to range partitions, sorted there, written once, and numbered from
    the partitions' sizes: one number a partition is all that one task sees. Ties are
    dealt by a hash of a row's number, so even a very frequent one fills no task.
    """
    tie = "_tie_" + out
    rows = checkpointed(rows.withColumn(tie, F.xxhash64(F.monotonically_increasing_id())))
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of a row's number in it
    dealt = rows.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    dealt = checkpointed(dealt.withColumns({"_part": F.shiftright(place, 33), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    return dealt.join(before, "_part").withColumn(out, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before", tie)
