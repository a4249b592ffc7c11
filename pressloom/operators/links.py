"""Failing links: their state, when they are due, and when a sweep stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.session import checkpointed

# Days after the first failure at which the next retry is due, by retries so far.
RETRY_DAYS = [7, 14, 30]


def dead_links(attempts: DataFrame) -> DataFrame:
    """(url, retry_count, first_failed_at, last_checked_at, error_type): urls that have failed since their last success.

    attempts(url, tried, seq, failed, error_type), ordered by tried and seq. Both steps are
    combining aggregates: the last success of each url, then the failures after it.
    """
    when = F.struct("tried", "seq")
    success = attempts.where(~F.col("failed")).groupBy("url").agg(F.max(when).alias("ok"))
    failures = attempts.where("failed").join(success, "url", "left").where(F.col("ok").isNull() | (when > F.col("ok")))
    return failures.groupBy("url").agg(
        (F.count("*") - 1).alias("retry_count"),
        F.min("tried").alias("first_failed_at"),
        F.max("tried").alias("last_checked_at"),
        F.max(F.struct("tried", "seq", "error_type"))["error_type"].alias("error_type"),
    )


def is_due(now: str) -> Column:
    """Whether a link's next retry has come: fewer than three retries so far, and its days since the first failure are over."""
    days = F.element_at(F.array(*map(F.lit, RETRY_DAYS)), (F.least("retry_count", F.lit(len(RETRY_DAYS) - 1)) + 1).cast("int"))
    return (F.col("retry_count") < len(RETRY_DAYS)) & (F.col("first_failed_at") + F.make_dt_interval(days) <= F.lit(now).cast("timestamp_ntz"))


def due(state: DataFrame, now: str) -> DataFrame:
    """The links to retry."""
    return state.where(is_due(now))


def recorded(state: DataFrame, failures: DataFrame, successes: DataFrame) -> DataFrame:
    """The state after a run: failures(url, tried, error_type) count one retry each, successes(url) leave it.

    A new link begins with no retries; ``first_failed_at`` of a known one stays. Several
    failures of one url in a run count each, the last one's kind is kept; a url that
    also succeeds in the run leaves. One combining aggregate and one join.
    """
    met = failures.groupBy("url").agg(F.count("*").alias("n"), F.min("tried").alias("first"), F.max(F.struct("tried", "error_type")).alias("last"))
    both = state.join(met, "url", "full").join(successes.select("url"), "url", "left_anti")
    return both.select(
        "url",
        F.coalesce(F.col("retry_count") + F.coalesce("n", F.lit(0)), F.col("n") - 1).alias("retry_count"),
        F.coalesce("first_failed_at", "first").alias("first_failed_at"),
        F.coalesce(F.col("last.tried"), F.col("last_checked_at")).alias("last_checked_at"),
        F.when(F.col("n").isNotNull(), F.col("last.error_type")).otherwise(F.col("error_type")).alias("error_type"),
    )


def sweep_end(pages: DataFrame, most_misses: int, group: str, order: str, hit: Column) -> DataFrame:
    """(group, stop): the order at which a sweep has had ``most_misses`` misses in a row; null if it never does.

    A hit resets the count. Rows are dealt by ranges of group and order, so even one
    group that holds all rows is spread over the tasks. Each range of a group is summed
    up: the misses that it begins and ends with, whether it has a hit, and where it
    stops by itself. The summaries, one a range, are then read in order: a run goes
    from one range into the next. Rows of equal order in a group may be taken in any order among themselves.
    """
    narrow = pages.select(F.col(group).alias("_g"), F.col(order).alias("_o"), hit.alias("_hit"))
    dealt = checkpointed(narrow.repartitionByRange("_g", "_o").sortWithinPartitions("_g", "_o").withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_g", "_part")
    upto = here.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    last = here.orderBy("_o").rowsBetween(1 - most_misses, 0)
    seen = dealt.withColumns({"_hits": F.sum(F.col("_hit").cast("int")).over(upto), "_at": F.row_number().over(here.orderBy("_o")), "_missed": F.sum((~F.col("_hit")).cast("int")).over(last)})
    leading = F.when((F.col("_hits") == 0) & (F.col("_at") < most_misses), F.col("_o"))
    summary = seen.groupBy("_g", "_part").agg(
        F.count("*").alias("rows"),
        F.array_sort(F.collect_list(leading)).alias("head"),  # fewer than most_misses
        (F.count("*") - F.coalesce(F.max(F.when(F.col("_hit"), F.col("_at"))), F.lit(0))).alias("tail"),
        F.max("_hit").alias("hit"),
        F.min(F.when(F.col("_missed") == most_misses, F.col("_o"))).alias("own"),
    )
    # misses since the last hit before a range: all rows of the ranges since the last one with a hit, and what that one ends with
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("done", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    carry = F.col("done") - F.coalesce(F.max(F.when(F.col("hit"), F.col("done") + F.col("rows") - F.col("tail"))).over(before), F.lit(0))
    reached = placed.withColumn("need", F.lit(most_misses) - F.least(carry, F.lit(most_misses)))
    across = F.when(F.col("need").between(1, F.size("head")), F.get("head", (F.col("need") - 1).cast("int")))
    # a range that begins with enough misses stops in them at the latest
    found = reached.groupBy("_g").agg(F.min(F.least(across, F.col("own"))).alias("stop"))
    return found.select(F.col("_g").alias(group), "stop")
