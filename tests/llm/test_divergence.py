"""The audit of sources against a plain reading with exact integers."""

import re
from collections import Counter, defaultdict

import pytest
from llm_support import ODD, SF, docs_of

from pressloom.llm import catalog, divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs=30, top=50):
    """The audit's rows of (text, lang, source)s."""
    read = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER)), lang or "", source or "") for t, lang, source in docs]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for terms, lang, _ in read:
        held[lang].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in held.items()}
    for terms, lang, source in read:
        counts[lang, source].update(t for t in terms if t in kept[lang])
        counts[lang, None].update(t for t in terms if t in kept[lang])
    share = {}
    for (lang, source), c in counts.items():
        bottom = sum(c.values()) + 5 * len(kept[lang])
        share[lang, source] = {t: 1 + 1_000_000_000 * (c[t] + 5) // bottom for t in kept[lang]}
    rows = []
    for lang, source in counts:
        if source is None:
            continue
        p, q = share[lang, source], share[lang, None]
        others = [(-sum(abs(p[t] - share[lang, s][t]) for t in p), s.encode()) for k, s in counts if k == lang and s not in (None, source)]
        rows += [(lang, source, "pair", s.decode(), -v, k + 1) for k, (v, s) in enumerate(sorted(others))]
        ahead = [(q[t] - p[t], t.encode()) for t in p if counts[lang, source][t] and p[t] > q[t]]
        rows += [(lang, source, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(ahead)[:top])]
    return sorted(rows)


def rows_of(df):
    assert df.columns[:6] == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r)[:6] for r in df.collect())


def table(spark, docs):
    return spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, term int")


def test_padded_terms_are_whole_terms():
    made = divergence.automaton(enumerate(["the", "he", "été"]))
    text = "The the, he THE-he bathe été ÉTÉ étés the"
    assert Counter(n for piece in divergence.padded(text) for _, n in made.iter(piece)) == {0: 4, 1: 2, 2: 1}


@pytest.mark.parametrize("sizes", [(2_000_000, 256, 256, 1 << 20), (12, 2, 2, 40)])
def test_odd_rows_and_small_blocks(spark, monkeypatch, sizes):
    for name, size in zip(("VOCABULARY", "TERM_BLOCK", "SOURCE_BLOCK", "PIECE"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, size)
    words = "alpha Beta gamma-delta ünder alpha eps'ilon zeta x".split()
    docs = [(t, lang, source) for t in ODD for lang, source in (("en", "s1"), (None, None), ("en", "é"), ("xx", "only"))]
    docs += [(" ".join(words[k % 5 :] * (1 + k % 3)), "en" if k % 2 else "de", f"s{k % 7}") for k in range(90)]
    docs += [(None, "de", "silent"), ("", "yy", "a"), (None, "yy", "b")]
    assert rows_of(divergence.audit(table(spark, docs), min_docs=4)) == brute(docs, min_docs=4)
    assert rows_of(divergence.audit(table(spark, docs), min_docs=10**6)) == brute(docs, min_docs=10**6)


def test_empty_table(spark):
    assert divergence.audit(docs_of(spark, [])).count() == 0


def test_query_against_plain_reading(spark, real):
    docs = [(r.text, r.lang, r.source) for r in real.collect()]
    assert rows_of(catalog.QUERIES["op12_divergence"](spark, SF)) == brute(docs)
