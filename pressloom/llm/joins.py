"""Joins of a large table with one row a key, where few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over this part of all rows is met by broadcast; there are fewer than that many such keys.
SHARE = 1000
#: No key of so few rows is too much for one task.
HOT = 1 << 17


def join_skewed(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` but ``n`` by ``key``, inner.

    table has one row a key, ``n`` is how many of ``rows`` have it, ``total`` how many
    rows there are. Keys with over HOT rows and over 1/SHARE of all, fewer than SHARE of them,
    are broadcast and their rows stay where they are; the others are shuffled. Null
    keys meet nothing; no rows give none.
    """
    plain = rows.join(table.drop(n), key)
    if total <= HOT:
        return plain
    hot = F.col(n) > max(HOT, total // SHARE)
    heavy = table.where(hot).drop(n)
    if heavy.isEmpty():
        return plain
    heavy = F.broadcast(heavy)  # fewer than SHARE rows
    return rows.join(heavy.select(key), key, "left_anti").join(table.where(~hot).drop(n), key).unionByName(rows.join(heavy, key))
