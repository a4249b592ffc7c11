"""Quality rules: a threshold table compiled into one Spark projection, built-in functions only.

``metrics`` adds counts of words, symbols, stop words, lines and repeats to a table;
``RULES`` states, per rule, a ratio of two counts and its allowed range; ``verdict``
compiles such a table into one boolean column. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.texts import free_name

SPACE = r"[\x20\x09-\x0D]+"
#: Words of a repeat's window.
WINDOW = 3

# Frequent function words of four languages, as written inside a sentence.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as was by this are be at or from an",
    "de": "der die und das den dem des von zu im ist mit für auf ein eine nicht sich auch",
    "fr": "le la les de des et du en un une est que qui dans pour pas par au sur avec",
    "es": "el la los las de y en que un una es por con para no se del al lo como",
}


class Rule(NamedTuple):
    """``low <= top / bottom <= high``; a bottom of 0 counts as a ratio of 0."""

    name: str
    top: str
    bottom: str
    low: float
    high: float


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.4),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(keys: Column) -> Column:
    """Words within windows found twice or more, from the windows' hashes ``keys`` (array<long>).

    Windows are sorted as hash prefix and position in one long, so equal windows
    become neighbours. Where prefixes do not tell all hashes apart, or positions do not fit,
    (hash, position) pairs are sorted instead.
    """
    position_bits = 24
    prefix = lambda x: F.shiftleft(F.shiftright(x, position_bits), position_bits)
    position = lambda x: x.bitwiseAND(F.lit((1 << position_bits) - 1))
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def starts(in_order: Column, key, place) -> Column:
        """Positions of the elements that equal a neighbour by ``key``, ascending."""
        same = lambda s: F.filter(s, lambda x, k: F.coalesce(key(F.get(s, k - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(s, k + 1)) == key(x), F.lit(False)))
        return F.sort_array(let(in_order, lambda s: F.transform(same(s), lambda x: place(x).cast("long"))))

    def covered(found: Column) -> Column:
        gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW).cast("long"))))
        return let(found, lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda a, x: a + x))

    packed = F.sort_array(F.transform(keys, lambda x, i: prefix(x).bitwiseOR(i.cast("long"))))
    paired = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    distinct = F.size(F.array_distinct(keys))
    exact = (F.size(keys) < 1 << position_bits) & (F.size(F.array_distinct(F.transform(keys, prefix))) == distinct)
    return (
        F.when(distinct == F.size(keys), F.lit(0).cast("long"))
        .when(exact, covered(starts(packed, prefix, position)))
        .otherwise(covered(starts(paired, lambda x: x["h"], lambda x: x["i"])))
    )


def metrics(docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] | None = None, out: str = "_counts") -> DataFrame:
    """``docs`` with the COUNTS (longs) as a struct ``out``.

    Words are runs of other than ASCII white space. Null and empty texts have no words, lines
    or symbols. n_lines counts \\n-split lines with a word; n_dup_lines those equal to
    an earlier one; n_repeat_words the words in 3-word windows found twice or more
    (windows are compared by 64-bit hash). Rows stay as they are, repeated ones too;
    a column named ``out`` is replaced, all others stay whatever their names; an empty
    table gives no rows.
    """
    stops = list(stop_words) if stop_words is not None else sorted(set(" ".join(STOP_WORDS.values()).split()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    word_name, line_name, key_name = (free_name(docs, x) for x in ("_w_words", "_w_lines", "_w_keys"))
    found = docs.withColumns({word_name: F.array_remove(F.split(text, SPACE), ""), line_name: F.filter(F.split(text, "\n"), has_word)})
    words, lines = F.col(word_name), F.col(line_name)
    size = F.size(words)
    window = lambda i: F.xxhash64(*(F.get(words, (i + k).cast("int")) for k in range(WINDOW)))
    indices = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)).otherwise(F.array().cast("array<int>"))
    found = found.withColumn(key_name, F.transform(indices, window))
    counts = {
        "n_words": size,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stops))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(F.col(key_name)),
    }
    # a generator, not a projection: later filters on the counts must not repeat the counting
    one = F.explode_outer(F.array(F.struct(*(counts[k].cast("long").alias(k) for k in COUNTS))))
    return found.withColumn(out, one).drop(word_name, line_name, key_name)


def base_failed(counts: str = "_counts") -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    c = F.col(counts)
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def verdict(rules: Sequence[Rule] = RULES, counts: str = "_counts") -> Column:
    """True where no rule of the table is broken: its rows compiled into one expression."""
    c = F.col(counts)
    out = F.lit(True)
    for rule in rules:
        ratio = F.when(c[rule.bottom] > 0, c[rule.top] / c[rule.bottom]).otherwise(F.lit(0.0))
        out = out & ratio.between(rule.low, rule.high)
    return out


def broken(rules: Sequence[Rule] = RULES, counts: str = "_counts") -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*(F.when(~verdict([r], counts), F.lit(r.name)) for r in rules)))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the table, repeated ones too, all columns as they are; null and empty texts go."""
    out = free_name(docs, "_counts")
    return metrics(docs, text_col, out=out).where(~base_failed(out) & verdict(rules, out)).drop(out)
