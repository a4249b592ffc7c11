"""Sweeps over groups of any size against plain counting."""

import random

from pyspark.sql import functions as F

from pressloom.operators.links import sweep_end


def brute(rows, most):
    stops = {}
    for g in {g for g, *_ in rows}:
        run, stop = 0, None
        for _, o, hit in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            run = 0 if hit else run + 1
            if run == most and stop is None:
                stop = o
        stops[g] = stop
    return stops


def test_stops_within_and_across_ranges_of_a_hot_group(spark):
    draw = random.Random(3)
    for most, share in ((1, 0.5), (3, 0.6), (7, 0.45), (40, 0.02), (400, 0.0)):
        rows = [("hot", i * 3, draw.random() < share) for i in range(1500)] + [(f"g{i % 20}", i, draw.random() < share) for i in range(300)] + [("one", 5, False), ("hits", 1, True), ("hits", 2, True)]
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, o long, hit boolean").repartition(5)
        found = {r.g: r.stop for r in sweep_end(df, most, "g", "o", F.col("hit")).collect()}
        assert found == brute(rows, most), most


def test_no_task_holds_the_hot_group(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").alias("o"), (F.col("id") % 2 == 0).alias("hit"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = rows.repartitionByRange("g", "o").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt < 12000
    assert sweep_end(rows, 2, "g", "o", F.col("hit")).first().stop is None
    assert sweep_end(rows.limit(0), 2, "g", "o", F.col("hit")).count() == 0
