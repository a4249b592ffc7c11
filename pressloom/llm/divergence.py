"""How the sources of a language differ in their words: an audit in two passes with exact counts.

The first pass counts, per language, the documents that hold each term, and keeps the
terms of enough documents. The second pass reads the texts again with an automaton of
the kept terms, each padded by a delimiter on both sides, and recounts every
occurrence by language and source. What both passes exchange is sparse: one row for a
term and a source that has it.

From these postings, terms are ranked by how much more often a source uses them than its
language does, and sources are compared in pairs: the postings are dealt into blocks
of terms and of sources, so one task fills a small matrix and adds up distances for
one block of terms, whatever the number of either. All shares are integers in parts per
1000 million, computed exactly.

The automaton holds at most VOCABULARY characters at once: a larger vocabulary is cut
into shares, and the texts are read once for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.texts import own, pieces
from pressloom.session import checkpointed

#: Fixed by the contract: a term's bytes are ASCII letters and all beyond ASCII; only A-Z are lowered.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
MIN_DOCS = 30
UNIT = 1_000_000_000
#: What is added to every count of a kept term.
SMOOTH = 5
TOP_TERMS = 50
#: Characters of kept terms (delimiters included) that one automaton holds.
VOCABULARY = 2_000_000
#: Different counts that a task holds before it passes them on.
HELD = 500_000
#: Bytes of a text that are matched at once.
PIECE = 1 << 20
#: Terms and sources in one block of the pairs' matrix.
TERM_BLOCK, SOURCE_BLOCK = 256, 256


def _name(column: str) -> Column:
    return F.coalesce(own(column).cast("string"), F.lit(""))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs): how many of a task's documents hold each term, added up as far as HELD allows."""
    counts: dict[str, Counter] = {}
    held = 0

    def out():
        terms = [t for c in counts.values() for t in c]
        langs = pa.array([lang for lang, c in counts.items() for _ in range(len(c))], type=pa.string())
        batch = pa.RecordBatch.from_arrays([langs, pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n for c in counts.values() for n in c.values()], type=pa.int64())], names=["lang", "term", "docs"])
        counts.clear()
        return batch

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            count = counts.setdefault(lang, Counter())
            terms = set()
            for piece in pieces((text.as_py() or "").encode().translate(_TERM_BYTES), PIECE):
                terms.update(piece.split())
            held -= len(count)
            count.update(terms)
            held += len(count)
            if held > HELD:
                yield out()
                held = 0
    yield out()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, term): the terms in at least ``min_docs`` documents of a language; null texts and languages read as ''."""
    each = docs.select(_name(lang_col).alias("lang"), own(text_col).cast("string").alias("text")).mapInArrow(_held, "lang string, term string, docs long")
    return each.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def automaton(terms: Iterable[tuple[int, str]]) -> ahocorasick.Automaton:
    """An automaton that gives a term's number wherever it stands between two blanks."""
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in terms:
        made.add_word(f" {term} ", number)
    made.make_automaton()
    return made


def padded(text: str | None) -> Iterator[str]:
    """A text's terms in pieces, lowered, each between two blanks; all else is blank."""
    for piece in pieces((text or "").encode().translate(_TERM_BYTES), PIECE):
        yield f" {piece.decode()} "


def _recount(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, list[tuple[int, str]]]) -> Iterator[pa.RecordBatch]:
    """(lang, source, number, n): occurrences of the vocabulary's terms, added up within a task as far as HELD allows."""
    made: dict[str, ahocorasick.Automaton] = {}
    counts: dict[tuple[str, str], Counter] = {}
    held = 0

    def out():
        numbers = np.fromiter((k for c in counts.values() for k in c), np.int64)
        n = np.fromiter((n for c in counts.values() for n in c.values()), np.int64)
        names = [pa.array([k[j] for k, c in counts.items() for _ in range(len(c))], type=pa.string()) for j in (0, 1)]
        counts.clear()
        return pa.RecordBatch.from_arrays([*names, pa.array(numbers), pa.array(n)], names=["lang", "source", "number", "n"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if lang not in vocabulary:
                continue
            if lang not in made:
                made[lang] = automaton(vocabulary[lang])
            count = counts.setdefault((lang, source), Counter())
            for piece in padded(text.as_py()):
                held -= len(count)
                count.update(map(itemgetter(1), made[lang].iter(piece)))
                held += len(count)
            if held > HELD:
                yield out()
                held = 0
    yield out()


def postings(docs: DataFrame, kept: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n): every occurrence of the terms of ``kept(lang, term)``, counted; a source without a term has no row.

    The vocabulary is cut by running length into shares of VOCABULARY characters at
    most (one term more, if it is longer); each is collected, sent to the tasks, and recounted.
    """
    numbered = kept.withColumn("size", F.length("term") + 2)
    # shares of near equal size by hash; a share that is still too large is cut in two by further bits
    total = numbered.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shares = 1
    while shares * VOCABULARY < total:
        shares *= 2
    share = lambda n: F.pmod(F.xxhash64("lang", "term"), F.lit(n))
    while shares < 1 << 20 and numbered.groupBy(share(shares).alias("s")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(f"size > {VOCABULARY} and n > 1").take(1):
        shares *= 2
    texts = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source"), own(text_col).cast("string").alias("text"))
    found = None
    for k in range(shares):
        terms = [(r.lang, r.term) for r in kept.where(share(shares) == k).orderBy("lang", "term").toLocalIterator()]
        vocabulary: dict[str, list] = {}
        for number, (lang, term) in enumerate(terms):
            vocabulary.setdefault(lang, []).append((number, term))
        names = docs.sparkSession.createDataFrame([(i, t) for i, (_, t) in enumerate(terms)], "number long, term string")
        counted = texts.mapInArrow(partial(_recount, vocabulary=vocabulary), "lang string, source string, number long, n long")
        counted = counted.groupBy("lang", "source", "number").agg(F.sum("n").alias("n")).join(names, "number").select("lang", "source", "term", "n")
        found = counted if found is None else found.unionByName(counted)
    return found


def shares_of(count: Column, total: Column, n_terms: Column) -> Column:
    """A smoothed share in parts of UNIT, at least 1: exact integers."""
    wide = [F.coalesce(x, F.lit(0)).cast("decimal(20,0)") for x in (count, total, n_terms)]
    top, bottom = F.lit(UNIT).cast("decimal(10,0)") * (wide[0] + SMOOTH), wide[1] + SMOOTH * wide[2]
    return F.lit(1).cast("long") + F.call_function("div", top, bottom)


def _distances(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of |p - q| over one block of terms, of all pairs of sources of two blocks.

    Rows without a term name a source, its share of a term it does not have, and how
    many terms the block holds; rows with a term, the source's share of it.
    """
    _, _, left, right = (k.as_py() for k in key)
    sources = rows.column("source").to_pylist()
    base = {s: p for s, t, p in zip(sources, rows.column("term").to_pylist(), rows.column("p").to_pylist(), strict=True) if t is None}
    names = {b: [] for b in (left, right)}
    for s, b in sorted({(s, b) for s, b in zip(sources, rows.column("block").to_pylist(), strict=True)}):
        names[b].append(s)
    terms = {t: i for i, t in enumerate(sorted({t for t in rows.column("term").to_pylist() if t is not None}))}
    tables = {b: np.repeat(np.array([[base[s]] for s in names[b]], dtype=np.int64).reshape(-1, 1), len(terms), axis=1) for b in names}
    place = {s: (b, i) for b in names for i, s in enumerate(names[b])}
    for s, t, p in zip(sources, rows.column("term").to_pylist(), rows.column("p").to_pylist(), strict=True):
        if t is not None:
            b, i = place[s]
            tables[b][i, terms[t]] = p
    out = ([], [], [])
    # terms that none of these sources has
    unseen = max(rows.column("n_here").drop_null().to_pylist(), default=0) - len(terms)
    alone = np.array([base[s] for s in names[right]], dtype=np.int64)
    for s, row in zip(names[left], tables[left], strict=True):
        sums = np.abs(tables[right] - row).sum(axis=1) + unseen * np.abs(alone - base[s])
        for other, value in zip(names[right], sums.tolist(), strict=True):
            if left != right or s < other:
                for a, b in ((s, other), (other, s)):
                    for column, x in zip(out, (a, b, value), strict=True):
                        column.append(x)
    lang = pa.array([key[0].as_py()] * len(out[0]), type=pa.string())
    return pa.table([lang, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["lang", "source", "item", "value"])


def pairs(counts: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): both orders of every two sources of a language, the absolute differences of their shares added up over all kept terms.

    ``counts(lang, source, term, p)`` has a share where a source has the term,
    ``groups(lang, source, p0, n_terms)`` every source with its share of a term it does not
    have, ``kept(lang, term)`` the terms. A row meets the blocks of sources it is compared
    with, so a task holds about TERM_BLOCK terms of 2 * SOURCE_BLOCK sources.
    """
    term_block = F.pmod(F.xxhash64("term"), F.greatest(F.lit(1).cast("long"), F.expr(f"n_terms div {TERM_BLOCK}"))).alias("term_block")
    source_block = F.pmod(F.xxhash64(F.lit(1), "source"), F.expr(f"n_sources div {SOURCE_BLOCK} + 1")).alias("block")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources"), F.expr(f"max(n_terms) div {TERM_BLOCK}").alias("n_blocks"))
    placed = groups.drop("n_terms").join(sizes, "lang").withColumn("block", source_block)
    here = kept.join(groups.select("lang", "n_terms").distinct(), "lang").groupBy("lang", term_block).agg(F.count("*").alias("n_here"))
    filled = counts.join(placed.select("lang", "source", "block", "n_sources"), ["lang", "source"]).select("lang", "source", "term", "p", term_block, F.lit(None).cast("long").alias("n_here"), "block", "n_sources")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n_blocks") - 1))).alias("term_block")
    blank = placed.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), every, "block", "n_sources")
    blank = blank.join(here, ["lang", "term_block"], "left").select(filled.columns)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n_sources div {SOURCE_BLOCK}"))).alias("other")
    met = filled.unionByName(blank).select("lang", "source", "term", "p", "term_block", "n_here", "block", other)
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    summed = met.groupBy("lang", "term_block", "low", "high").applyInArrow(_distances, "lang string, source string, item string, value long")
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how every source of a language differs from the others and from the language.

    Part ``pair`` has every other source of the language, farthest first; part ``term``
    the ``top`` kept terms that the source has and uses more than the language does,
    by the difference. Equal values rank by the item's bytes. Null texts, languages and sources read
    as ''. Sources without terms, and languages that keep none, have pairs all the same
    (with 0 if no term is kept); a language's only source has none. Repeated rows count as
    often as they occur; an empty table gives no rows; other columns are not read.
    """
    options = {"text_col": text_col, "lang_col": lang_col}
    kept = checkpointed(kept_terms(docs, min_docs, **options))
    counts = checkpointed(postings(docs, kept, source_col=source_col, **options))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    groups = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)).cast("long"))
    nothing = F.lit(0)
    share = lambda count: shares_of(count, F.col("total"), F.col("n_terms"))
    # where no term is kept there is nothing to share
    groups = checkpointed(groups.withColumn("p0", F.when(F.col("n_terms") > 0, share(nothing)).otherwise(F.lit(0).cast("long"))))
    filled = checkpointed(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n_terms", share(F.col("n")).alias("p")))
    apart = pairs(filled, groups.select("lang", "source", "p0", "n_terms"), kept)
    overall = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("n_terms").alias("n_terms"))
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(overall, "lang").select("lang", "term", share(F.col("n")).alias("q"))
    ahead = filled.join(in_lang, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = [
        apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")),
        ahead.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top),
    ]
    return both[0].unionByName(both[1])
