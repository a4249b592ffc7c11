"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A token budget goes down the tree by weight. A
node can take at most its subtree's supply (its tokens times the epochs allowed), so
what a child cannot take is shared among its siblings by weight first, and only what
a whole subtree cannot take is shared among its ancestors' siblings. Each leaf then
takes whole epochs and, of one more epoch in seeded order, the longest prefix of
documents within the rest of its budget.

Integer arithmetic throughout: shares of a node add up to its budget exactly. The
seeded order is that of MD5(seed|epoch|id). The prefix's end is found by narrowing
buckets of leading digits, so no leaf is ever sorted as a whole, and whole texts are
never shuffled: the plan has one row per leaf and is broadcast while it is small.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.texts import free_name, own
from pressloom.session import checkpointed

LEVELS = ("domain", "lang", "source")
#: Leaves up to which the plan is broadcast; beyond, it is joined by shuffle.
BROADCAST_LEAVES = 200_000
#: Leading digits of the seeded order that buckets are narrowed by.
DIGITS = (2, 4)


def words(text: Column | str) -> Column:
    """The number of words, runs of other than ASCII white space: the default token count."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(children: DataFrame, parents: list[str], budget: str = "budget") -> DataFrame:
    """``children`` with ``share`` of their parent's budget; columns name, weight and cap (longs) are read.

    Children that cannot take their weighted part take their cap; the rest is split
    by weight, rounded cumulatively by name so that nothing is lost. The children of one
    parent are sorted by one task, as rows of a few numbers; no children give no rows.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    zero = F.lit(0).cast("long")
    full = children.withColumn(
        "full",
        F.col("cap").cast("decimal(38,0)") * F.sum("weight").over(onward)
        <= F.col("weight").cast("decimal(19,0)") * (F.col(budget) - F.coalesce(F.sum("cap").over(before), zero)),
    )
    open_weight = F.when(~F.col("full"), F.col("weight")).otherwise(zero)
    split = full.withColumns(
        {
            "open_total": F.sum(open_weight).over(whole),
            "rest": F.col(budget) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(whole),
            "upto": F.sum(open_weight).over(Window.partitionBy(*parents).orderBy("name").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    part = F.expr("(upto * rest) div open_total - ((upto - weight) * rest) div open_total")
    return split.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("full", "open_total", "rest", "upto")


def plan(leaves: DataFrame, weights: Mapping[tuple[str, ...], int], budget: Column, epochs: int, default_weight: int = 1) -> DataFrame:
    """(domain, lang, source, tokens, share): the budget of every leaf of ``leaves(domain, lang, source, tokens)``.

    weights: {path: weight} for paths of one to three names, positive integers; a path
    that is not listed has ``default_weight``. ``budget`` is a long over the total
    ``supply``; a budget over the supply is cut to it.
    """
    spark = leaves.sparkSession
    spec = [["\x1f".join(k), int(w)] for k, w in weights.items()]
    if min([default_weight, *(w for _, w in spec)]) < 1:
        raise ValueError("weights are positive integers")
    table = spark.createDataFrame(spec or [["", default_weight]], "path string, weight long")
    nodes = leaves.withColumn("cap", F.col("tokens") * int(epochs))
    root = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("cap"), F.lit(0)).alias("supply"))
    parents = root.select(F.lit(0).alias("all"), F.least(budget.cast("long"), F.col("supply")).alias("budget"))
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        level = nodes.groupBy(F.lit(0).alias("all"), *path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        above = ["all", *LEVELS[:depth]]
        level = level.join(parents, above).withColumn("path", F.concat_ws("\x1f", *path)).join(F.broadcast(table) if len(spec) <= BROADCAST_LEAVES else table, "path", "left")
        level = level.withColumns({"weight": F.coalesce("weight", F.lit(default_weight)).cast("long"), "name": F.col(name)})
        found = shares(level, above)
        parents = found.select("all", *path, F.col("share").alias("budget"))
    return found.select(*LEVELS, "tokens", "share")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def select(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[tuple[str, ...], int],
    fraction: float | None = None,
    budget: int | None = None,
    epochs: int = 2,
    seed: int = 42,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    out: str = "_mix",
) -> DataFrame:
    """``docs`` with a struct ``out`` of domain, lang, source, n_tokens and copies, the epochs that take the row, where that is positive.

    The budget is ``budget`` tokens or ``fraction`` of all. ``tokens`` counts a row's
    tokens (default: words). Null names count as ''. Rows without tokens are not
    selected. Rows with equal ids in a leaf share one place in the order: all or none
    of them are in the prefix. Null ids are one such id. A column named ``out`` is
    replaced, all others stay whatever their names. An empty table gives no rows.
    """
    if (fraction is None) == (budget is None):
        raise ValueError("give either fraction or budget")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = dict(zip(LEVELS, (name(domain), name(F.col(lang_col)), name(F.col(source_col))), strict=True))
    own_id = name(F.col(id_col))
    counted = (tokens if tokens is not None else words(text_col)).cast("long")
    some = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]") if tokens is None else tokens > 0)
    narrow = checkpointed(some.select(*(c.alias(k) for k, c in leaf.items()), own_id.alias("id"), counted.alias("n")))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    goal = F.lit(int(budget)) if fraction is None else F.floor(F.col("total") * F.lit(float(fraction)))
    cut = plan(leaves, weights, goal, epochs).selectExpr(*LEVELS, "share div tokens as epoch", "share % tokens as rest")
    cut = checkpointed(cut)
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("id")))
    part = _small(cut.where("rest > 0"))
    keys = checkpointed(narrow.join(part.select(*LEVELS, "epoch"), list(LEVELS)).select(*LEVELS, place.alias("place"), "n"))
    bound = cut.where("rest > 0").select(*LEVELS, "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("taken"))
    width = 0
    upto = Window.partitionBy(*LEVELS).orderBy("bucket")
    for digits in DIGITS:
        inside = keys.join(_small(bound), list(LEVELS)).where(F.substring("place", 1, width) == F.col("prefix"))
        sums = inside.groupBy(*LEVELS, F.substring("place", 1, digits).alias("bucket")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("taken").alias("taken"))
        sums = sums.withColumn("sum", F.col("taken") + F.sum("n").over(upto))
        # the first bucket that passes the rest; there is one, for the rest is less than the leaf
        over = sums.where("sum > rest and sum - n <= rest")
        bound = checkpointed(over.select(*LEVELS, "rest", F.col("bucket").alias("prefix"), (F.col("sum") - F.col("n")).alias("taken")))
        width = digits
    inside = keys.join(_small(bound), list(LEVELS)).where(F.substring("place", 1, width) == F.col("prefix"))
    peers = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("sum", F.col("taken") + F.sum("n").over(peers)).where("sum <= rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    ends = bound.join(fits, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "prefix").alias("last"))
    leaf_name, cut_name = free_name(docs, "_leaf"), free_name(docs, "_cut")
    final = checkpointed(cut.join(ends, list(LEVELS), "left").select(F.struct(*LEVELS).alias(leaf_name), F.struct("epoch", "last").alias(cut_name)))
    here = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(cut_name)["epoch"].cast("string"), own_id))
    copies = F.col(cut_name)["epoch"] + F.when(here <= F.col(cut_name)["last"], 1).otherwise(0)
    placed = some.withColumn(leaf_name, F.struct(*(c.alias(k) for k, c in leaf.items()))).join(_small(final), leaf_name).where(copies > 0)
    facts = F.struct(*(F.col(leaf_name)[x].alias(x) for x in LEVELS), counted.alias("n_tokens"), copies.cast("long").alias("copies"))
    return placed.withColumn(out, facts).drop(leaf_name, cut_name)


def repeated(selected: DataFrame, columns: list[str], out: str = "_mix") -> DataFrame:
    """``columns`` of the rows of ``select``, each row as often as epochs take it."""
    copy = free_name(selected, "_copy")
    return selected.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(out)["copies"]))).select(*map(own, columns))


def take(docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], int], **options) -> DataFrame:
    """The rows that ``select`` takes, each as often as epochs take it, all columns as they are, whatever their names."""
    out = free_name(docs, "_mix")
    return repeated(select(docs, domain, weights, **options, out=out), docs.columns, out)
