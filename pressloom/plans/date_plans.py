"""Queries on publication dates: every shape written out from order dates and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import dates
from pressloom.plans.registry import query
from pressloom.session import load
from pressloom.sources.adapter import NOW

#: Order dates twelve years on, with a time of day by the order's number.
DATED_SQL = "d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + INTERVAL 12 YEAR AS day, o_orderkey % 1440 AS minute FROM orders)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("to_date(o_orderdate) + interval 12 years").alias("day"))
    minute = (F.col("id") % 1440).cast("int")
    return orders.withColumns({"minute": minute, "at": F.expr("cast(day as timestamp_ntz) + make_dt_interval(0, 0, cast(id % 1440 as int))")})


def pick(by: Column, choices: list[Column]) -> Column:
    return F.element_at(F.array(*choices), (by % len(choices) + 1).cast("int"))


#: Text shapes and whether they keep the time.
SHAPES = [("MMMM d, yyyy h:mm a", 1), ("MMMM d yyyy", 0), ("yyyy-MM-dd", 0), ("d MMMM yyyy hh:mm a", 1), ("dd MMM yyyy h:mma", 1), ("d MMM yyyy", 0), ("d MMMM yyyy", 0), ("dd/MM/yyyy", 0), ("d-M-yyyy", 0), ("yyyy.MM.dd", 0), ("dd MM yyyy", 0), ("MMMM d, yyyy HH:mm", 0)]


@query("date_shapes", f"WITH {DATED_SQL} SELECT id, CAST(epoch(day) - 19800 + CASE WHEN id % {len(SHAPES) + 1} IN ({', '.join(str(k) for k, (_, t) in enumerate(SHAPES) if t)}) THEN minute * 60 ELSE 0 END AS BIGINT) AS at FROM d")
def date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of a date in text, times of day and the Sinhala months included, as seconds since 1970."""
    orders = dated(spark, sf_dir)
    sinhala = F.concat_ws(" ", F.year("day"), F.element_at(F.array(*map(F.lit, dates.SINHALA_MONTHS)), F.month("day")), F.dayofmonth("day"))
    said = pick(F.col("id"), [*(F.date_format("at", s) for s, _ in SHAPES), sinhala])
    found = dates.from_text(F.concat(F.lit("Written by staff, "), said, F.lit(" | read it")), NOW)
    return orders.select("id", F.unix_seconds(found).alias("at"))


STRICT = [
    ("concat(date_format(at, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z')", "epoch(day) + minute * 60"),
    ("concat(date_format(at, \"yyyy-MM-dd'T'HH:mm:ss\"), '+05:30')", "epoch(day) + minute * 60 - 19800"),
    ("concat(date_format(at, \"yyyy-MM-dd'T'HH:mm:ss\"), '.250000-0800')", "epoch(day) + minute * 60 + 28800"),
    ("concat(date_format(at, 'yyyy-MM-dd HH:mm:ss'), '+0000')", "epoch(day) + minute * 60"),
    ("concat(' ', date_format(at, 'yyyy-MM-dd'), ' ')", "epoch(day) - 19800"),
    ("date_format(at, \"yyyy-MM-dd'T'HH:mm:ss\")", "NULL"),
    ("date_format(at, \"EEE, dd MMM yyyy HH:mm:ss '+0530'\")", "epoch(day) + minute * 60 - 19800"),
    ("date_format(at, \"d MMM yyyy HH:mm 'GMT'\")", "epoch(day) + minute * 60"),
    ("date_format(at, \"EEE, d MMM yy HH:mm:ss 'EST'\")", "epoch(day) + minute * 60 + 18000"),
    ("date_format(at, 'dd MMM yyyy HH:mm:ss')", "epoch(day) + minute * 60 - 19800"),
    ("concat('on ', date_format(at, 'yyyy-MM-dd'))", "NULL"),
]


@query("date_strict", f"WITH {DATED_SQL} SELECT id, CAST(CASE id % {len(STRICT)} {' '.join(f'WHEN {k} THEN {sql}' for k, (_, sql) in enumerate(STRICT))} END AS BIGINT) AS at FROM d")
def date_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO and mail formats with and without zones; strings that are neither give null."""
    said = pick(F.col("id"), [F.expr(e) for e, _ in STRICT])
    return dated(spark, sf_dir).select("id", F.unix_seconds(dates.strict(said, NOW)).alias("at"))


@query(
    "date_waterfall",
    f"WITH {DATED_SQL} SELECT id, CASE id % 6 WHEN 5 THEN NULL ELSE strftime(day + to_days(CAST(id % 6 AS INTEGER)), '%Y-%m-%d') END AS day FROM d",
)
def date_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level k of the waterfall holds the day k days on; levels above the row's own hold nothing valid."""
    orders = dated(spark, sf_dir)
    level = F.col("id") % 6
    later = lambda k, form: F.date_format(F.date_add("day", k), form)
    at = lambda k, good, bad: F.when(level <= k, good).otherwise(bad)
    found = dates.waterfall(
        at(0, later(0, "yyyy-MM-dd"), F.lit("2001-02-03")),
        at(1, F.concat(F.lit("Posted "), later(1, "MMMM d, yyyy")), F.lit("soon, or on 31 February 2020")),
        at(2, F.concat(F.lit("https://a.example/"), later(2, "yyyy/MM/dd"), F.lit("/story")), F.lit("https://a.example/2012/13/01/story")),
        at(3, F.concat(F.repeat(F.lit("word "), 500), later(3, "dd/MM/yyyy")), F.concat(F.repeat(F.lit("word "), 600), F.lit("2012-01-01"))),
        at(4, later(4, "EEE, dd MMM yyyy '10:00:00 +0530'"), F.lit("Tue, 04 Feb 2099 14:39:00 +0530")),
        NOW,
    )
    return orders.select("id", dates.local_day(found).cast("string").alias("day"))


#: Texts whose first match of some pattern is impossible or out of range, and the local time that counts.
TRAPS = {
    "old 2001-01-01 then 5 February 2020": "2020-02-05 00:00",
    "January 1, 2000": None,
    "1 January 2099 10:00 am": None,
    "1 January 1970": None,
    "2024-02-02 00:00": "2024-02-02 00:00",
    "2024-02-05": None,
    "31 February 2020, 2020-02-28": "2020-02-28 00:00",
    "February 4, 2020 14:39 pm": "2020-02-04 00:00",
    "February 4, 2020 12:39 am": "2020-02-04 00:39",
    "February 4, 2020 12:39PM": "2020-02-04 12:39",
    "Feb 4, 2020": None,
    "4 Feb 2020 1:05 pm": "2020-02-04 13:05",
    "2020-1-5": None,
    "5/1/2020": "2020-01-05 00:00",
    "5 1 2020": None,
    "5 01 2020": "2020-01-05 00:00",
    "32/01/2020 05-06-2020": None,
    "2020 මැයි 9 | x": "2020-05-09 00:00",
    "No date here": None,
    "": None,
}


@query("date_traps", f"SELECT doc_id AS id, [{', '.join(chr(39) + v + chr(39) if v else 'NULL' for v in TRAPS.values())}][doc_id % {len(TRAPS)} + 1] AS found FROM documents")
def date_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern is judged by itself: an invalid first match gives way to the next pattern."""
    said = F.element_at(F.array(*map(F.lit, TRAPS)), (F.col("doc_id") % len(TRAPS) + 1).cast("int"))
    table = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), said.alias("said"))
    at = F.unix_seconds(dates.from_text(F.col("said"), NOW)) + 19800
    shown = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86400).cast("int")).cast("string"), F.format_string(" %02d:%02d", F.floor(at % 86400 / 3600).cast("int"), F.floor(at % 3600 / 60).cast("int")))
    return table.select("id", F.when(at.isNotNull(), shown).alias("found"))


@query("dates_parsed", "SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 12 YEAR, '%Y-%m-%d') AS day FROM orders")
def dates_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick(F.col("id"), [F.date_format("day", s) for s in ("MMMM d, yyyy", "yyyy-MM-dd", "d MMM yyyy", "dd/MM/yyyy", "d MM yyyy")])
    found = dates.waterfall(None, None, None, F.concat(F.lit("Published on "), said, F.lit(", by staff")), None, NOW)
    return dated(spark, sf_dir).select("id", dates.local_day(found).cast("string").alias("day"))


@query("month_ranges", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last FROM orders UNION ALL SELECT '2024-13', NULL, NULL")
def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last days of months given as text; what is no month has neither."""
    months = load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    some = months.unionByName(spark.createDataFrame([("2024-13",)], "month string")).withColumn("r", dates.month_range(F.col("month")))
    return some.select("month", F.col("r.first").cast("string").alias("first"), F.col("r.last").cast("string").alias("last"))


ROUND = "CAST(floor({} + 0.5) AS BIGINT)"


@query(
    "relative_times",
    f"""WITH e AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, CAST(floor(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) AS BIGINT) AS s, value FROM events)
SELECT id, CASE WHEN s < 3600 THEN {ROUND.format('s / 60')} || 'm ago' WHEN s < 86400 THEN {ROUND.format('s / 3600')} || 'h ago' ELSE {ROUND.format('s / 86400')} || 'd ago' END AS ago,
  CASE WHEN value < 60 THEN {ROUND.format('value')} || 's' ELSE {ROUND.format('value / 60')} || 'm' END AS took,
  CASE date_diff('day', day, DATE '2024-01-31') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(day, '%a, %b %-d') END AS label FROM e""",
)
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as people read them: minutes, hours or days ago, durations and day labels."""
    second = lambda c: F.unix_seconds(c.cast("timestamp"))
    past = second(F.lit(NOW).cast("timestamp_ntz")) - second(F.col("ts"))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), dates.ago(past).alias("ago"), dates.duration(F.col("value")).alias("took"), dates.day_label(F.to_date("ts"), F.lit(NOW[:10]).cast("date")).alias("label")
    )
