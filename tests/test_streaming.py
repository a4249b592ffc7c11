"""Streams give what the batch operators give."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressloom.operators.links import dead_links
from pressloom.sources.adapter import attempts
from pressloom.sources.buckets import Buckets
from pressloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def split(df, folder, n=3):
    for k in range(n):
        df.where(F.col("event_id") % n == k).write.mode("append").parquet(folder)


def test_attempts_survive_a_restart_and_give_the_batch_state(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    split(events, f"{tmp_path}/events.parquet")
    for _ in range(2):
        source = ingest.stream(spark, f"{tmp_path}/events.parquet", events)
        kind = F.element_at(F.array(*map(F.lit, ("404", "timeout", "empty", "503"))), (F.col("event_id") % 4 + 1).cast("int"))
        tried = source.select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("ts").alias("tried"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), kind.alias("error_type"))
        ingest.keep_attempts(tried, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    assert sorted(ingest.state(spark, f"{tmp_path}/log").collect()) == sorted(dead_links(attempts(spark, SF)).collect())


def test_titles_once_a_week_and_days_counted(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for name, make, mode in (
        ("fresh", lambda s: ingest.fresh_titles(s.select("ts", "user_id"), "ts", ["user_id"], 40), "append"),
        ("days", lambda s: ingest.activity(s), "complete"),
    ):
        query = make(ingest.stream(spark, f"{tmp_path}/events.parquet", events)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    fresh = [r.user_id for r in spark.table("fresh").collect()]
    assert sorted(fresh) == sorted({r.user_id for r in events.select("user_id").distinct().collect()})
    wanted = {r.day: r.n for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert {r.day: r.n for r in spark.table("days").collect()} == wanted


def made_attempts(source):
    kind = F.element_at(F.array(*map(F.lit, ("404", "timeout", "empty", "503"))), (F.col("event_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 31).cast("string"))
    return source.select(url.alias("url"), F.col("ts").cast("timestamp").alias("tried"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), kind.alias("error_type"))


def test_link_states_follow_the_batch_fold_through_a_restart(spark, tmp_path):
    """The state machine in the state store, upserted into a table, equals the fold over all attempts in order."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    cuts = ["2024-01-10", "2024-01-20", "2024-02-10"]
    table = Buckets(spark, f"{tmp_path}/links", "url", StructType.fromDDL("url string, failing boolean, retry_count int, first_failed_at timestamp, last_checked_at timestamp, error_type string"), 8)
    for k, until in enumerate(cuts):
        since = cuts[k - 1] if k else "2023-01-01"
        events.where((F.col("ts") >= since) & (F.col("ts") < until)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        source = made_attempts(ingest.stream(spark, f"{tmp_path}/in/events.parquet", events))
        ingest.cycle(ingest.link_states(source), ingest.upserting(table), f"{tmp_path}/check").awaitTermination()
    found = sorted(tuple(r) for r in table.read().where("failing").select("url", "retry_count", "first_failed_at", "last_checked_at", "error_type").collect())
    wanted = sorted(tuple(r) for r in dead_links(made_attempts(events)).select("url", "retry_count", "first_failed_at", "last_checked_at", "error_type").collect())
    assert found == wanted and len(found) > 20


def test_a_failing_batch_is_retried_then_set_aside_and_replayed_and_nothing_is_lost(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id")
    split(events, f"{tmp_path}/events.parquet", 4)
    table = Buckets(spark, f"{tmp_path}/all", "event_id", events.schema, 4)
    put, tried = ingest.upserting(table), []

    def run(batch, number):
        tried.append(number)
        if number == 1 or number == 2 and tried.count(2) == 1:
            raise ValueError(f"a cycle that fails, {number}")
        put(batch, number)

    quarantine = f"{tmp_path}/quarantine"
    for _ in range(2):  # a restart from the checkpoint takes no batch again
        source = ingest.stream(spark, f"{tmp_path}/events.parquet", events)
        ingest.cycle(source, ingest.guarded(run, quarantine, attempts=2), f"{tmp_path}/check").awaitTermination()
    assert tried == [0, 1, 1, 2, 2, 3]
    waiting = ingest.quarantined(spark, quarantine)
    assert {(r["_batch"], r["_error"]) for r in waiting.select("_batch", "_error").distinct().collect()} == {(1, "ValueError: a cycle that fails, 1")}
    assert table.read().count() + waiting.count() == events.count()
    assert ingest.replay(spark, put, quarantine) == [1] and ingest.replay(spark, put, quarantine) == []
    assert ingest.quarantined(spark, quarantine).count() == 0
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(tuple(r) for r in events.collect())


def test_a_batch_that_can_be_neither_run_nor_set_aside_ends_the_query_and_comes_again(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id")
    split(events, f"{tmp_path}/events.parquet", 2)
    table = Buckets(spark, f"{tmp_path}/all", "event_id", events.schema, 4)
    (tmp_path / "file").write_text("no folder")

    def broken(batch, number):
        raise ValueError("no")

    start = lambda run: ingest.cycle(ingest.stream(spark, f"{tmp_path}/events.parquet", events), run, f"{tmp_path}/check")
    with pytest.raises(StreamingQueryException):
        start(ingest.guarded(broken, f"{tmp_path}/file", attempts=1)).awaitTermination()
    start(ingest.upserting(table)).awaitTermination()
    assert table.read().count() == events.count()


def test_unseen_urls_are_added_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id")
    split(events, f"{tmp_path}/events.parquet", 4)
    table = Buckets(spark, f"{tmp_path}/seen", "user_id", events.schema, 4)
    put = ingest.appending_unseen(table, ["ts", "event_id"])
    ingest.cycle(ingest.stream(spark, f"{tmp_path}/events.parquet", events), put, f"{tmp_path}/check").awaitTermination()
    before = sorted(tuple(r) for r in table.read().collect())
    put(events, 99)
    assert sorted(tuple(r) for r in table.read().collect()) == before
    assert [r[0] for r in before] == sorted(r.user_id for r in events.select("user_id").distinct().collect())


def test_sessions_and_dates(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-01 10:00:00"), (3, None), (4, "2001-01-01 00:00:00"), (5, "2030-01-01 00:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    good = ingest.accepted(rows, "ts", "2024-01-31 00:00:00")
    assert sorted(r.k for r in good.collect()) == [1, 1, 1, 2]
    assert sorted((r.k, r.n) for r in ingest.sessions(good, "k").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_stories_grow_batch_by_batch_and_assignments_stay(spark, tmp_path):
    """New rows join the stories of the last days or open their own; what was assigned never changes, also when a batch comes twice."""
    rows = [(i, f"2024-01-{1 + i // 4:02d} 0{i % 4}:00:00", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(16)]
    rows.append((99, "2024-02-20 00:00:00", [1.0, 0.0]))
    vectors = spark.createDataFrame(rows, "id long, at string, v array<double>").withColumn("at", F.col("at").cast("timestamp"))
    table = Buckets(spark, f"{tmp_path}/clusters", "id", StructType.fromDDL("id long, story string, head boolean, at timestamp, v array<double>, batch long"), 4)
    run, seen = ingest.clustering(table, 0.9, ["at", "id"], "v", "at"), {}
    for k in range(5):
        batch = vectors.where((F.col("id") >= 4 * k) & (F.col("id") < 4 * k + 4)) if k < 4 else vectors.where("id in (3, 99)")
        run(batch, k)
        now = {r.id: (r.story, r.head) for r in table.read().collect()}
        run(batch, k)
        assert now == {r.id: (r.story, r.head) for r in table.read().collect()}
        assert seen.items() <= now.items()
        seen = now
    odd, even = {seen[i][0] for i in range(1, 16, 2)}, {seen[i][0] for i in range(0, 16, 2)}
    assert len(odd) == len(even) == 1 and odd != even
    assert {i for i in seen if seen[i][1]} == {0, 1, 99} and seen[99][0] not in odd | even
