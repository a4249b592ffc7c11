"""Dates in long texts: only the part from the first digit on is searched, and nothing is lost."""

from pyspark.sql import functions as F

from pressloom.functions import dates
from pressloom.sources.adapter import NOW


def test_texts_are_searched_from_their_first_digit_on(spark):
    said = ["", None, "no digit " * 300, "word " * 500 + "03/02/2020", "x" * 99 + " September \n 4, 2020 10:05 pm", "xMay 4, 2020", "é́May 4, 2020", "-May   4 2020 | 2021-02-03", "a2020-02-03 5 May 2020", "é 2020 මැයි 9"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", dates._dated(F.col("t")).alias("d"), dates.from_text(F.col("t"), NOW).alias("a"), F.coalesce(*dates.shapes(F.col("t"), NOW).values()).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a is not None for r in rows) >= 5
    assert [r.d for r in rows[:3]] == [None] * 3 and all(len(r.d) < 60 for r in rows[3:])
