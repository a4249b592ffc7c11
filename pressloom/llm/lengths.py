"""Exact token-length histograms and what follows from them for every context limit.

Documents are counted by encoded length, a combining aggregate of one row per length.
Suffix sums over the histogram then answer, for each length taken as a context limit:
how many documents reach it, the tokens of those below it, the tokens that remain
when every document is cut to it, and the share of documents within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.session import checkpointed

#: Lengths in one block: suffix sums run within blocks and over the blocks' sums.
BLOCK = 256


def histogram(docs: DataFrame, n_tokens: Column) -> DataFrame:
    """(length, n_docs): every row counted once; a null length counts as 0; no rows give none."""
    return docs.select(F.coalesce(n_tokens, F.lit(0)).cast("long").alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def context_limits(lengths: DataFrame) -> DataFrame:
    """One row per occurring length, with it as the context limit.

    docs_at_least and tokens_at_least are suffix sums; docs_within and total_within
    are what is at most the limit; total_truncated is the tokens left when longer documents are
    cut to the limit; share_within is the quantile of the limit. A limit between two
    occurring lengths L1 < x < L2 has the suffix sums of L2, and total_truncated =
    total - tokens_at_least(L2) + x * docs_at_least(L2).

    lengths(length, n_docs) is written once, so documents are encoded once. Rows that
    repeat a length count together; a null length or count is 0; a length of 0 is a
    limit like any other; no rows give none. Other columns are not read.
    """
    zero = F.lit(0).cast("long")
    once = checkpointed(lengths.groupBy(F.coalesce("length", zero).alias("length")).agg(F.coalesce(F.sum("n_docs"), zero).alias("n_docs")))
    rows = once.withColumns({"block": F.expr(f"length div {BLOCK}"), "n_tokens": F.col("length") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(after), zero).alias(f"{c}_after") for c in ("d", "t")),
        *(F.sum(c).over(every).alias(f"{c}_all") for c in ("d", "t")),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(blocks, "block").withColumns(
        {
            "docs_at_least": F.sum("n_docs").over(within) + F.col("d_after"),
            "tokens_at_least": F.sum("n_tokens").over(within) + F.col("t_after"),
        }
    )
    docs_within = F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")
    return found.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        docs_within.alias("docs_within"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens")).alias("total_within"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("total_truncated"),
        (docs_within / F.col("d_all")).alias("share_within"),
    )


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """(wanted, total_truncated, docs_over) for any context limits, from ``context_limits``' rows."""
    picks = [
        F.struct(
            F.lit(int(x)).cast("long").alias("wanted"),
            F.sum(F.when(F.col("context_limit") <= x, F.col("context_limit")).otherwise(int(x)) * F.col("n_docs")).alias("total_truncated"),
            F.sum(F.when(F.col("context_limit") > x, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        )
        for x in wanted
    ]
    return limits.agg(F.array(*picks).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """(length): the smallest length with at least ``share`` of the documents within it."""
    return limits.where(F.col("share_within") >= share).agg(F.min("context_limit").alias("length"))
