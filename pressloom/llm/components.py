"""Connected components of an undirected link table, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.joins import HOT, join_skewed
from pressloom.session import checkpointed


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free sum of hashes: equal for equal edge sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node reachable.

    Alternates the large-star and small-star contractions until the edge set no
    longer changes, O(log^2 n) rounds at worst and two or three on stars. A round
    takes minima per node (combined before the shuffle) and joins them back; the minima
    of hubs, nodes with over a thousandth of very many links, are broadcast to their links, so
    no task gathers a hub. Every round is checkpointed, so a lost executor costs one round.

    Self-links are ignored, repeated and reversed links count once, null ends are
    dropped, and no links give no rows.
    """
    edges = checkpointed(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(edges)
    while before[0]:
        total = 2 * before[0]
        # what a hub check reads again is written first
        written = checkpointed if total > HOT else lambda df: df
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the links of a to greater nodes; those to smaller ones only lower the minimum
        upward = F.count(F.when(F.col("b") > F.col("a"), 1))
        lowest = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), upward.alias("n")).where("n > 0"))
        large = written(join_skewed(both.where("b > a"), lowest, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        floor = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_skewed(large, floor, "a", "n", total).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
