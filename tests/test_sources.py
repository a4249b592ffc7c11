"""Feeds as a data source, table functions in SQL, and retry timers in a stream."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from pressloom.functions.register import register
from pressloom.operators import links
from pressloom.plans import catalog
from pressloom.sources import feeds
from pressloom.streaming import ingest, retries

SF = "/root/testdata/sf0.001"

RSS = """<?xml version="1.0" encoding="ISO-8859-1"?><rss version="2.0"><channel><title>no item</title>
<item><title>Caf\xe9 &amp; B</title><link>https://a.example/1</link><pubDate>Tue, 04 Feb 2025 14:39:00 +0530</pubDate><description>&lt;img src='https://i.example/x.png'&gt;</description></item>
<item><guid>g2</guid></item><item><title>old</title><link>l</link><pubDate>Tue, 04 Feb 2020 14:39:00 GMT</pubDate></item><item><title>no link</title></item>
<item><title>odd date</title><link>l3</link><pubDate>some day</pubDate></item></channel></rss>""".encode("latin-1")
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link href="https://f.example/"/>
<entry><title>E1</title><link rel="enclosure" href="https://f.example/e.mp3"/><link rel="alternate" href="https://f.example/1"/><id>i1</id><updated>2025-03-01T10:00:00Z</updated><published>2025-02-28T09:00:00+01:00</published><summary>s1</summary></entry>
<entry><title>E2</title><id>i2</id><updated>2019-01-01T00:00:00Z</updated><content type="html">c2</content></entry></feed>"""


def written(folder):
    (folder / "sub").mkdir(parents=True)
    (folder / "a.xml").write_bytes(RSS)
    (folder / "sub" / "b.atom").write_bytes(ATOM)
    (folder / "broken.xml").write_bytes(RSS[: RSS.index(b"<item><guid>")] + b"<item>")
    (folder / "note.txt").write_text("no feed")


def test_feeds_of_both_forms(spark, tmp_path):
    written(tmp_path / "f")
    feeds.register(spark)
    rows = spark.read.format("feed").load(str(tmp_path / "f"))
    assert rows.rdd.getNumPartitions() == 3
    got = sorted(((r.title, r.link, r.pub_date, r.description, r.image_url) for r in rows.collect()), key=str)
    one = ("Café & B", "https://a.example/1", "Tue, 04 Feb 2025 14:39:00 +0530", "<img src='https://i.example/x.png'>", "https://i.example/x.png")
    assert got == sorted([one, one, ("Untitled", "g2", None, None, None), ("odd date", "l3", "some day", None, None), ("E1", "https://f.example/1", "2025-02-28T09:00:00+01:00", "s1", None), ("E2", "i2", "2019-01-01T00:00:00Z", "c2", None)], key=str)
    assert {r.link: r.published for r in rows.where("link = 'https://f.example/1'").collect()} == {"https://f.example/1": datetime(2025, 2, 28, 8)}


def test_dates_are_filtered_by_the_reader(spark, tmp_path):
    written(tmp_path / "f")
    feeds.register(spark)
    rows = spark.read.format("feed").load(str(tmp_path / "f"))
    some = rows.where((F.col("published") >= F.lit("2025-02-10").cast("timestamp")) & (F.col("title") != "x"))
    assert [r.title for r in some.collect()] == ["E1"]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "published >= " not in plan.split("RelationV2")[0] or "2025-02-10" not in plan.split("RelationV2")[0]
    assert rows.where(F.col("published") < F.lit("2025-02-10").cast("timestamp")).count() == 3


def test_a_feed_stream_goes_on_where_it_was(spark, tmp_path):
    written(tmp_path / "f")
    feeds.register(spark)
    read = lambda: spark.readStream.format("feed").load(str(tmp_path / "f")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    read()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    time.sleep(0.05)
    (tmp_path / "f" / "late.rss").write_bytes(RSS)
    for _ in range(2):
        read()
        assert spark.read.parquet(f"{tmp_path}/out").groupBy("file").count().count() == 4 and spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_table_functions_in_lateral_joins(spark):
    register(spark)
    spark.read.parquet(f"{SF}/pages.parquet").createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT page_id, l.position, l.href, l.text FROM some_pages, LATERAL html_links(html, url, '^/') AS l")
    wanted = catalog.QUERIES["html_links"](spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    parts = spark.sql("SELECT page_id, x.title FROM some_pages, LATERAL html_extract(html) AS x")
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, catalog.QUERIES["html_articles"](spark, SF).select("page_id", "title").collect()))
    odd = spark.sql("SELECT id, x.title, x.content FROM VALUES (1, CAST(NULL AS STRING)), (2, '') AS v(id, h), LATERAL html_extract(h) AS x").collect()
    assert [tuple(r) for r in odd] == [(1, None, None), (2, None, None)]


def test_due_links_equal_the_batch_at_each_step(spark, tmp_path):
    """Rows given out so far, less what happened since, are what the batch finds due at the watermark; also across restarts."""
    for name, value in retries.STORE.items():
        spark.conf.set(name, value)
    events = spark.read.parquet(f"{SF}/events.parquet")
    url = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 31).cast("string"))
    made = lambda df: df.select(url.alias("url"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("tried"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), F.lit("404").alias("error_type"))
    cuts = ["2023-12-01", "2024-01-10", "2024-01-20", "2024-02-05", "2024-03-30"]
    try:
        for k, (since, until) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = events.where((F.col("ts") >= since) & (F.col("ts") < until))
            # a last attempt that succeeds moves the time on to the end of the step
            tick = spark.createDataFrame([(10**9 + k, -1, "click", until)], "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType))
            part.unionByName(tick, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
            source = made(ingest.stream(spark, f"{tmp_path}/in/events.parquet", events))
            put = lambda batch, number: batch.write.mode("append").parquet(f"{tmp_path}/out")
            ingest.cycle(retries.retries(source), put, f"{tmp_path}/check").awaitTermination()
            state = links.dead_links(made(events.where(F.col("ts") < until)))
            batch = {(r.url, r.retry_count, r.first_failed_at) for r in links.due(state.withColumn("first_failed_at", F.col("first_failed_at").cast("timestamp_ntz")), until).collect()}
            given = spark.read.parquet(f"{tmp_path}/out").where("kind = 'due'").withColumn("first_failed_at", F.col("first_failed_at").cast("timestamp_ntz"))
            still = {(r.url, r.retry_count, r.first_failed_at) for r in state.select("url", "retry_count", F.col("first_failed_at").cast("timestamp_ntz").alias("first_failed_at")).collect()}
            got = [(r.url, r.retry_count, r.first_failed_at) for r in given.collect()]
            assert len(got) == len(set(got)) and batch == set(got) & still, until
            assert k == 0 or len(batch) > 5
        permanent = {r.url for r in spark.read.parquet(f"{tmp_path}/out").where("kind = 'permanent'").collect()}
        assert permanent >= {r.url for r in state.where("retry_count >= 3").collect()}
    finally:
        for name in retries.STORE:
            spark.conf.unset(name)
