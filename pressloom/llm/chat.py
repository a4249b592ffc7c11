"""Chat formatting in budgeted windows.

Prefix sums of turn tokens place every turn on its conversation's axis. What the budget
leaves beside the conversation's own system turn and the history is a window's
capacity. Turns whose start falls into the same stretch of half of it form one
turn-aligned span; a turn longer than the other half closes its stretch as a span of
its own, with as much history as it leaves room for. So a window exceeds the budget only where the system
turn and one other turn do. Every window repeats the system turn and the last turns
before it within the history. Repeats are marked in the template and masked; every
assistant turn is under the loss mask exactly once.

Prefix sums run within blocks of turns and over the blocks' sums, and windows are
bounded by the budget, so a conversation of any length is spread over many tasks.
Tokens are counted once, and windows are laid out on numbers: texts are shuffled into
blocks, written, and shuffled again only to meet their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.session import checkpointed

# Strings that control chat templates.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"]
#: Turn numbers in one block of the prefix sums.
BLOCK = 64
#: Tokens that the template adds to a turn.
OVERHEAD = 4

_OPEN = {False: "<|turn:", True: "<|again:"}
_END = "<|end|>\n"


def escape(text: Column | str) -> Column:
    r"""Texts in which no control string is left: \ becomes \e, and the first character of one \l or \b."""
    angles = "|".join(c[1:].replace("|", r"\|") for c in CONTROL if c[0] == "<")
    squares = "|".join(c[1:].replace("]", r"\]") for c in CONTROL if c[0] == "[")
    out = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\\"), F.lit("\\e"))
    out = F.regexp_replace(out, F.lit(f"<(?={angles})"), F.lit("\\\\l"))
    return F.regexp_replace(out, F.lit(rf"\[(?={squares})"), F.lit("\\\\b"))


def unescape(text: Column | str) -> Column:
    """The inverse of ``escape``; \\p, which roles use, is a bar."""
    out = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\p"), F.lit("|"))
    return F.replace(F.replace(out, F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def _written(rows: DataFrame) -> DataFrame:
    """``rows(key, conv_id, turn, role, text, tokens)`` in blocks of turns, numbered and escaped, written once.

    ``inside`` is the tokens before a row within its block. What follows works on the
    numbers alone; texts are met again by (key, block, no) when windows are put together.
    """
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long"))
    order = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return checkpointed(
        rows.select(
            "key",
            "conv_id",
            "block",
            F.row_number().over(order).alias("no"),
            F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("inside"),
            "tokens",
            (F.col("role") == "system").alias("system"),
            (F.col("role") == "assistant").alias("answer"),
            F.replace(escape("role"), F.lit("|"), F.lit("\\p")).alias("name"),
            escape("text").alias("body"),
        )
    )


def _placed(written: DataFrame, budget: int, history: int) -> DataFrame:
    """The rows' numbers with ``start`` on the conversation's axis and the window ``win`` they belong to.

    The system turn is before the axis, which the turns after it begin at 0. ``room`` is what it leaves of the
    budget and ``past`` the history within that; where it leaves nothing, windows are laid out as if there were none.
    """
    system = F.min(F.when((F.col("no") == 1) & F.col("system"), F.col("tokens"))).alias("first")
    sums = written.groupBy("key", "block").agg(F.sum("tokens").alias("sum"), system)
    over = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("first").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select("key", "block", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("offset"), F.coalesce(first, F.lit(0)).alias("kept"))
    own = written.select("key", "block", "no", "inside", "tokens", "system", "answer", F.length("name").alias("name_chars"), F.length("body").alias("body_chars"))
    placed = own.join(sums, ["key", "block"]).withColumn("at", F.col("offset") + F.col("inside"))
    placed = placed.withColumns({"system": F.col("system") & (F.col("at") == 0), "start": F.greatest(F.lit(-1), F.col("at") - F.col("kept"))}).drop("offset", "inside", "at")
    left = F.lit(budget) - F.col("kept")
    fits = left >= 3
    placed = placed.withColumn("room", F.when(fits, left).otherwise(budget)).withColumn("past", F.when(fits, F.least(F.lit(history), F.expr("room div 3"))).otherwise(0))
    stride, other = F.expr("(room - past) div 2"), F.expr("room - past - (room - past) div 2")
    win = F.when(F.col("system"), 0).otherwise(F.floor(F.col("start") / F.greatest(F.lit(1), stride)) * 2 + F.when(F.col("tokens") > other, 1).otherwise(0))
    return checkpointed(placed.withColumn("win", win.cast("long")))


def windows(
    turns: DataFrame,
    tokens: Column,
    budget: int = 1024,
    history: int = 256,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, win, n_tokens, over_budget, formatted, loss): the formatted windows of every conversation.

    tokens: the length of a row's text, to which OVERHEAD is added. budget: of a
    window; of it, the system turn (a first turn whose role is system) takes what it
    has, and repeated turns take ``history``, or a third of what the system turn leaves if that is less.
    loss: array of (start, length) in characters of ``formatted``, over each new assistant text.

    Turns are ordered by number, ties by role and text; repeated rows are turns of
    their own. Null roles and texts count as empty, a null turn number comes first,
    rows with a null conversation form one conversation; ids may be of any type that
    casts to a string. A turn that does not fit beside the system turn gets a window alone
    with it, and ``over_budget`` is true; no other window is over the budget, unless the
    system turn takes all of it. An empty table gives no rows. Other columns are not
    read, so their names cannot clash.
    """
    if history < 0 or budget < 4 * OVERHEAD:
        raise ValueError(f"a budget of at least {4 * OVERHEAD} tokens, and a history of none or more")
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(
        key.alias("key"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"), (F.coalesce(tokens, F.lit(0)) + OVERHEAD).cast("long").alias("tokens")
    )
    written = _written(rows)
    placed = _placed(written, budget, history)
    by_win = Window.partitionBy("key").orderBy("win")
    # a window of one long turn repeats only what fits beside it
    fits = F.greatest(F.lit(0), F.least(F.min("past"), F.min("room") - F.max("tokens")))
    spans = placed.groupBy("key", "win").agg(F.min("start").alias("from"), F.when(F.col("win") % 2 == 1, fits).otherwise(F.min("past")).alias("past"))
    later = [F.struct(*(F.lead(c, k).over(by_win).alias(c) for c in ("win", "from", "past"))) for k in (1, 2, 3)]
    spans = spans.select("key", "win", F.array(*later).alias("later"))
    # a turn is in its own window and, within the history, in the windows that start soon after it
    near = F.filter("later", lambda w: w["from"] - F.col("start") <= w["past"])
    member = placed.join(spans, ["key", "win"]).withColumn("also", F.when(F.col("system"), F.array().cast("array<bigint>")).otherwise(near["win"]))
    numbers = ["block", "no", "tokens", "answer", "name_chars", "body_chars"]
    turned = member.select("key", "start", *numbers, F.col("win").alias("own"), F.explode(F.concat(F.array("win"), "also")).alias("win"))
    turned = turned.select("key", "win", F.col("start").alias("pos"), *numbers, (F.col("win") != F.col("own")).alias("again"))
    first = placed.where("system").select("key", F.col("win").alias("own"), *numbers)
    kept = spans.select("key", "win").join(first, "key").where("win <> own")
    kept = kept.select("key", "win", F.lit(-1).cast("long").alias("pos"), *numbers, F.lit(True).alias("again"))

    mark = lambda of: F.when(F.col("again"), of(_OPEN[True])).otherwise(of(_OPEN[False]))
    head = F.col("name_chars") + mark(lambda x: F.lit(len(x))) + len("|>")
    before = Window.partitionBy("key", "win").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(head + F.col("body_chars") + len(_END)).over(before), F.lit(0)) + head
    parts = turned.unionByName(kept).withColumn("at", at.cast("long"))
    loss = F.when(F.col("answer") & ~F.col("again"), F.struct(F.col("at").alias("start"), F.col("body_chars").cast("long").alias("length")))
    parts = parts.select("key", "block", "no", "win", "pos", "tokens", "again", loss.alias("loss"))
    chunk = F.concat(mark(F.lit), F.col("name"), F.lit("|>"), F.col("body"), F.lit(_END))
    met = written.select("key", "conv_id", "block", "no", "name", "body").join(parts, ["key", "block", "no"])
    made = met.groupBy("key", "win").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum("tokens").alias("n_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", chunk.alias("chunk")))), lambda x: x["chunk"]), "").alias("formatted"),
        F.array_sort(F.collect_list("loss")).alias("loss"),
    )
    return made.select("conv_id", "win", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"), "formatted", "loss")


def parsed(formatted: Column | str) -> Column:
    """The turns of a formatted window, array of (again, role, text), unescaped."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    again = lambda p: F.startswith(p, F.lit(_OPEN[True]))
    return F.transform(
        pieces,
        lambda p: F.struct(
            again(p).alias("again"),
            unescape(F.substring_index(p, "|>", 1).substr(F.when(again(p), len(_OPEN[True]) + 1).otherwise(len(_OPEN[False]) + 1), F.lit(1 << 30))).alias("role"),
            unescape(p.substr(F.instr(p, "|>") + 2, F.lit((1 << 31) - 1))).alias("text"),
        ),
    )


def masked(formatted: Column | str, loss: Column | str) -> Column:
    """All text under the loss mask of a window, unescaped."""
    whole = F.col(formatted) if isinstance(formatted, str) else formatted
    return F.array_join(F.transform(loss, lambda s: unescape(whole.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


_DIGEST = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams windows sorted by conversation; holds only the running digests of one."""
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, said, lost, sums = None, None, None, None

    def closed() -> tuple:
        return (sums["conv_id"], sums["turns"], said.hexdigest(), sums["loss"], lost.hexdigest(), sums["chars"], sums["windows"])

    for batch in batches:
        done, kinds[0] = [], batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if r["key"] != now:
                if now is not None:
                    done.append(closed())
                now, said, lost = r["key"], hashlib.sha256(), hashlib.sha256()
                sums = {"conv_id": r["conv_id"], "turns": 0, "loss": 0, "chars": 0, "windows": 0}
            said.update(r["said"].encode())
            lost.update(r["lost"].encode())
            for name, value in (("turns", r["n"]), ("loss", len(r["lost"])), ("chars", r["chars"]), ("windows", 1)):
                sums[name] += value
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if now is not None:
        yield pa.record_batch([pa.array([c], k) for c, k in zip(closed(), kinds, strict=True)], names=names)


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation read back from its formatted windows: turns, loss text and sizes.

    Windows are streamed to the digests in order through a sorted shuffle. Repeats
    are recognised by their mark in the text. conv_id keeps its type, and the rows with
    a null one are one conversation. An empty table gives no rows.
    """
    turns = F.filter(F.col("turns"), lambda t: ~t["again"])
    read = made.withColumn("turns", parsed("formatted")).select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("key"),
        "conv_id",
        "win",
        F.size(turns).cast("long").alias("n"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        masked("formatted", "loss").alias("lost"),
        F.length("formatted").cast("long").alias("chars"),
    )
    return read.repartition("key").sortWithinPartitions("key", "win").mapInArrow(_hash, _DIGEST.format(made.schema["conv_id"].dataType.simpleString()))
