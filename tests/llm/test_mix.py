"""Hierarchical budgets and seeded prefixes against a recursive reading, and the SQL oracles."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from llm_support import ODD, docs_of
from pyspark.sql import functions as F

from pressloom.llm import catalog, mix

SF = "/root/testdata/sf0.001"


def fill(children, budget):
    """{name: share} for {name: (weight, cap)}."""
    open_, left, out = dict(children), budget, {}
    while True:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if Fraction(left * w, total) >= cap]
        if not full:
            break
        for n in full:
            out[n] = open_.pop(n)[1]
            left -= out[n]
        if not open_:
            return out
    upto = 0
    for n in sorted(open_):
        w = open_[n][0]
        out[n] = (upto + w) * left // total - upto * left // total
        upto += w
    return out


def expected(docs, weights, fraction, epochs, seed):
    leaves = defaultdict(list)
    for i, *leaf, n in docs:
        if n:
            leaves[tuple(leaf)].append((i, n))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budgets = {(): min(int(sum(tokens.values()) * fraction), sum(tokens.values()) * epochs)}
    for depth in (1, 2, 3):
        caps = defaultdict(lambda: defaultdict(int))
        for leaf, n in tokens.items():
            caps[leaf[: depth - 1]][leaf[:depth]] += n * epochs
        budgets |= {n: s for parent, own in caps.items() for n, s in fill({n: (weights.get(n, 1), c) for n, c in own.items()}, budgets[parent]).items()}
    out = {}
    for leaf, own in leaves.items():
        epoch, rest = divmod(budgets[leaf], tokens[leaf])
        place = lambda i, epoch=epoch: hashlib.md5(f"{seed}|{epoch}|{i}".encode()).hexdigest()
        total, inside = 0, set()
        for i, n in sorted(own, key=lambda x: place(x[0])):
            total += n
            if total > rest:
                break
            inside.add(i)
        out |= {i: epoch + (i in inside) for i, _ in own if epoch + (i in inside)}
    return out


@pytest.mark.parametrize(("fraction", "epochs"), [(0.3, 1), (0.9, 1), (1.5, 2), (5.0, 3), (0.0, 1)])
def test_copies_follow_the_budgets(spark, fraction, epochs):
    rows = [(i, ("a", "b")[i % 5 == 0], ("x", "y", "z")[i % 3], f"s{i % 4}", i * 7 % 50) for i in range(400)]
    weights = {("a",): 1, ("b",): 9, ("b", "x"): 4, ("a", "y", "s1"): 7}
    docs = spark.createDataFrame([(i, d, l, s, " w" * n) for i, d, l, s, n in rows], "doc_id long, dom string, lang string, source string, text string")
    found = mix.select(docs, F.col("dom"), weights, fraction=fraction, epochs=epochs, seed=7)
    got = {r.doc_id: r._mix.copies for r in found.collect()}
    assert got == expected(rows, weights, fraction, epochs, 7)
    if fraction == 1.5:
        assert mix.repeated(found, docs.columns).count() == sum(got.values())


def test_nulls_repeats_and_no_rows(spark):
    docs = docs_of(spark, [*ODD, "again words", "again words"], ids=[*range(len(ODD)), 77, 77]).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    got = mix.select(docs, F.lit(None).cast("string"), {}, fraction=2.0, epochs=2)
    assert {r.doc_id: r._mix.copies for r in got.collect()} == {r.doc_id: 2 for r in docs.collect() if (r.text or "").strip(" \t\n\x0b\x0c\r")}
    assert mix.select(docs_of(spark, []), F.lit("d"), {}, fraction=1.0).count() == 0
    with pytest.raises(ValueError):
        mix.select(docs, F.lit("d"), {})


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_equal_their_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).select(*columns).collect())) == sorted(want.fetchall())


def test_columns_of_clashing_names_stay(spark):
    """Columns named like the operator's own, in any case of letters, come through unchanged."""
    docs = docs_of(spark, [f"w {k} " * (1 + k % 3) for k in range(30)])
    plain = {r.doc_id: r._mix.copies for r in mix.select(docs, F.lit("d"), {}, fraction=0.5).collect()}
    names = ["_mix", "_LEAF", "_cut", "_copy", "epoch", "place", "_domain", "_epoch", "a.b", "rest", "tokens", "n"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    found = mix.take(wide, F.lit("d"), {}, fraction=0.5)
    assert found.columns == wide.columns
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == Counter(plain)
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
