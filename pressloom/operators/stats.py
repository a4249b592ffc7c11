"""Dashboard statistics over articles, sources and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_source(sources: DataFrame, articles: DataFrame, dead: DataFrame) -> DataFrame:
    """Conditional counts of every source, those without articles too; dead(slug) is counted beside.

    Articles are counted by source before the join, so only one row a source is joined.
    """
    count = lambda c: F.count(F.when(c, 1))
    counted = articles.groupBy("slug").agg(
        F.count("*").alias("total"),
        count(F.col("qa_status").isNull()).alias("unreviewed"),
        *(count(F.col("qa_status") == s).alias(s) for s in ("pass", "warn", "fail")),
        F.max("published_at").alias("last_published"),
    )
    lost = dead.groupBy("slug").agg(F.count("*").alias("dead_links"))
    found = sources.select("slug").join(counted, "slug", "left").join(lost, "slug", "left")
    numbers = ["total", "unreviewed", "pass", "warn", "fail", "dead_links"]
    return found.select("slug", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), "last_published")


def by_error(attempts: DataFrame) -> DataFrame:
    """Failures by url and kind; urls without a failure have no row, 5xx codes count as other."""
    count = lambda c: F.count(F.when(c, 1))
    kind = F.col("error_type")
    named = ("404", "timeout", "empty")
    return attempts.where("failed").groupBy("url").agg(
        F.count("*").alias("total"), *(count(kind == k).alias(f"err_{k}") for k in named), count(~kind.isin(*named)).alias("err_other")
    )


def coverage(sources: DataFrame, articles: DataFrame, since: str, until: str) -> DataFrame:
    """(slug, day, n) for every source and day of the range, ends included, zeros too."""
    days = F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date")))
    counted = articles.select("slug", F.to_date("published_at").alias("day")).groupBy("slug", "day").agg(F.count("*").alias("n"))
    return sources.select("slug", days.alias("day")).join(counted, ["slug", "day"], "left").select("slug", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gaps(grid: DataFrame, least_days: int = 0) -> DataFrame:
    """Per source: articles, mean a day, days without any and their share; sources with fewer such days go."""
    found = grid.groupBy("slug").agg(F.sum("n").alias("total"), F.count("*").alias("days"), F.count(F.when(F.col("n") == 0, 1)).alias("gap_days"))
    return found.where(F.col("gap_days") >= least_days).select("slug", "total", (F.col("total") / F.col("days")).alias("mean"), "gap_days", (100 * F.col("gap_days") / F.col("days")).alias("gap_percent"))


def by_kind(state: DataFrame, key: str) -> DataFrame:
    """Failing links of state(key, retries, kind) by key: all, those given up, those to retry, and by kind; 5xx codes count as other."""
    count = lambda c: F.count(F.when(c, 1))
    named = ("404", "timeout", "empty")
    return state.groupBy(key).agg(
        F.count("*").alias("total"),
        count(F.col("retries") >= 3).alias("permanent"),
        count(F.col("retries") < 3).alias("retryable"),
        *(count(F.col("kind") == k).alias(f"err_{k}") for k in named),
        count(~F.col("kind").isin(*named)).alias("err_other"),
    )


def typed_properties(rows: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """``rows`` with ``form`` (missing, malformed, or the kind of the value: object, array or scalar) and a column of its type for each of ``fields``, {name: type}.

    The text is read once, into a VARIANT. A path that is not there, or a value that is
    not of the type and cannot be cast to it, is null; nothing fails.
    """
    parsed = rows.withColumn("_variant", F.try_parse_json(text))
    kind = F.schema_of_variant("_variant")
    form = F.when(F.col(text).isNull(), "missing").when(F.col("_variant").isNull(), "malformed").when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise("scalar")
    typed = [F.try_variant_get("_variant", f"$.{name}", of).alias(name) for name, of in fields.items()]
    return parsed.select(*rows.columns, form.alias("form"), *typed)


def property_schema(rows: DataFrame, text: str) -> DataFrame:
    """(schema, n): one schema that all well-formed values of a column fit, and how many there are: an aggregate that combines."""
    parsed = rows.select(F.try_parse_json(text).alias("v"))
    return parsed.agg(F.schema_of_variant_agg("v").alias("schema"), F.count("v").alias("n"))
