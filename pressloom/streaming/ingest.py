"""Structured Streaming: deduplicated items, daily activity, failing links, seen urls, sessions and clustering runs.

What needs state keeps it in Spark's state store under the query's checkpoint, or in a
keyed table of hash buckets of which a batch rewrites those it touches; both survive a
restart, and a batch that is run again leaves the same rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressloom.operators.links import dead_links
from pressloom.session import checkpointed
from pressloom.sources.buckets import Buckets, exists

log = logging.getLogger(__name__)


def stream(spark, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """The Parquet files of a folder (or one file's folder by glob) as a stream, so many files a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def fresh_titles(items: DataFrame, at: str, key: list[str], days: int = 7) -> DataFrame:
    """The first item of each key within ``days``, by event time; state older than that goes."""
    return items.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(key)


def activity(events: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """(day, n): items by day, each day once its watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(key, start, end, n): sessions of events with less than ``gap`` between them."""
    grouped = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def accepted(items: DataFrame, at: str, now: str) -> DataFrame:
    """Items whose date is neither missing, before 2006 nor more than two days after ``now``."""
    day = F.col(at)
    return items.where(day.isNotNull() & (day >= F.lit("2006-01-01").cast("timestamp")) & (day <= F.lit(now).cast("timestamp") + F.expr("interval 2 days")))


_STATE = "retries int, first_failed long, last_checked long, error string"
_LINK = "url string, failing boolean, retry_count int, first_failed_at timestamp, last_checked_at timestamp, error_type string"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One url's state over its new attempts: a failure adds a retry, a success ends the state."""
    held = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["tried", "seq"], kind="stable")
    for r in rows.itertuples(index=False):
        if not r.failed:
            held = None
        else:
            at = r.tried.value // 1000
            held = (held[0] + 1 if held else 0, held[1] if held else at, at, r.error_type)
    if held is None:
        if state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], False, None, pd.NaT, pd.NaT, None)], columns=[c.split()[0] for c in _LINK.split(", ")])
    else:
        state.update(held)
        yield pd.DataFrame([(key[0], True, held[0], pd.Timestamp(held[1], unit="us"), pd.Timestamp(held[2], unit="us"), held[3])], columns=[c.split()[0] for c in _LINK.split(", ")])


def link_states(attempts: DataFrame) -> DataFrame:
    """The state of every url that a batch of attempts(url, tried, seq, failed, error_type) touches, after it.

    A state machine in the state store: no retries at first, one more at each failure
    since, no state after a success. Attempts of one url within a batch are taken in
    order; one batch's attempts of a url are what a task holds.
    """
    return attempts.groupBy("url").applyInPandasWithState(_follow, _LINK, _STATE, "update", GroupStateTimeout.NoTimeout)


def upserting(table: Buckets, newest: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function that puts each batch's rows, one a key, in place of the table's; with ``newest``, never older ones in place of newer ones."""
    return lambda batch, number: table.upsert(batch.dropDuplicates([table.key]), newest)


def appending_unseen(table: Buckets, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that adds the first row of each key that the table has not seen."""
    return lambda batch, number: table.insert(batch, order)


BATCH, ERROR = "_batch", "_error"


def guarded(run: Callable[[DataFrame, int], None], quarantine: str, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A batch function that loses no row: a batch that fails ``attempts`` times is written to ``quarantine`` with its number and error, and the query goes on.

    ``replay`` gives such batches to the function again. If the quarantine can't be written
    either, the error ends the query, which takes the batch again from its checkpoint.
    """

    def safe(batch: DataFrame, number: int) -> None:
        for attempt in range(attempts):
            try:
                return run(batch, number)
            except Exception as error:
                log.warning("batch %s failed, attempt %s", number, attempt + 1, exc_info=True)
                said = f"{type(error).__name__}: {error}"[:2000]
        batch.withColumn(ERROR, F.lit(said)).write.mode("overwrite").parquet(f"{quarantine}/rows/{BATCH}={number}")

    return safe


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame | None:
    """The rows of batches that wait, with _batch and _error; None if no batch ever failed."""
    if not exists(spark, f"{quarantine}/rows"):
        return None
    rows = spark.read.parquet(f"{quarantine}/rows")
    done = f"{quarantine}/replayed"
    return rows.join(spark.read.parquet(done), BATCH, "left_anti") if exists(spark, done) else rows


def replay(spark: SparkSession, run: Callable[[DataFrame, int], None], quarantine: str) -> list[int]:
    """Gives the waiting batches to ``run`` in their order and notes each that succeeds; the first error is raised. The numbers of the batches done.

    A batch that succeeded but was not noted is run again, so ``run`` must bear that, as upserts and inserts do.
    """
    waiting = quarantined(spark, quarantine)
    numbers = [] if waiting is None else sorted(r[0] for r in waiting.select(BATCH).distinct().collect())
    for number in numbers:
        run(waiting.where(F.col(BATCH) == number).drop(BATCH, ERROR), number)
        spark.createDataFrame([(number,)], f"{BATCH} int").coalesce(1).write.mode("append").parquet(f"{quarantine}/replayed")
    return numbers


def cycle(source: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a query that gives every batch to ``run``: each ``every`` (300 seconds, say), or what there is and then ends."""
    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def clustering(table: Buckets, threshold: float, order: list[str], vector: str, at: str, hours: int = 48) -> Callable[[DataFrame, int], None]:
    """A batch function that gives every new row a story and changes no assignment that was made before.

    table(id, story, rank, head, at, vector) holds what was assigned: a story is named by the row
    that opened it, ``head``. A batch's rows that the table lacks are clustered among themselves in ``order``; a
    cluster joins the most similar story that had a row within twice ``hours`` before the
    batch's latest, by the vectors of their first rows, at ``threshold`` or more, else it opens one. A batch that is run again
    finds what it assigned before left out and the same stories.
    """
    from pressloom.operators import stories

    def run(batch: DataFrame, number: int) -> None:
        key = table.key
        before = table.read().where(F.col("batch") < number)
        fresh = checkpointed(batch.select(*dict.fromkeys([key, at, vector, *order])).dropDuplicates([key]).join(before.select(key), key, "left_anti"))
        latest = fresh.agg(F.max(at)).first()[0]
        if latest is None and fresh.isEmpty():
            return
        since = F.lit(latest) - F.make_dt_interval(F.lit(0), F.lit(2 * hours))
        live = before.where(F.col(at) > since).select("story").distinct()
        known = before.where(F.col("head")).join(live, "story", "left_semi").select("story", F.col(key).alias("rank"), F.col(vector).alias("vector"))
        grouped = checkpointed(stories.clusters(fresh.withColumn("block", F.lit(number).cast("long")), threshold, "block", order, key, vector))
        first = F.min_by(F.struct(F.col(key).alias("key"), F.col(vector).alias("vector")), F.struct(*order)).alias("f")
        heads = grouped.join(fresh, key).groupBy("block", "cluster").agg(first).select("block", "cluster", F.col("f.key").alias("first"), F.col("f.vector").alias("vector"))
        met = checkpointed(stories.matched(heads, known, threshold)).join(heads.select("block", "cluster", "first"), ["block", "cluster"])
        assigned = grouped.join(met, ["block", "cluster"]).join(fresh, key)
        opens = F.col("is_new") & (F.col("story") == F.concat(F.lit("new-"), F.col("block").cast("string"), F.lit("-"), F.col("cluster").cast("string"))) & (F.col("first") == F.col(key))
        table.upsert(assigned.select(key, "story", opens.alias("head"), F.col(at), F.col(vector), F.col("block").alias("batch")))

    return run


def keep_attempts(attempts: DataFrame, folder: str, checkpoint: str):
    """A query that appends every attempt to a Parquet table, from which ``state`` is read; restartable from its checkpoint."""
    return attempts.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def state(spark, folder: str) -> DataFrame:
    """The links that fail now, over all attempts that have been written."""
    return dead_links(spark.read.parquet(folder))
