"""The fitted operators: held-out accuracy, recovered parameters and odd inputs."""

import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import regex
from llm_support import ODD, docs_of
from pyspark.sql import functions as F

from pressloom.llm import catalog, quality_rules, toxicity, weak_quality
from pressloom.llm.texts import pieces

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    grader = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    held = labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "said")
    counted = grader.grade(docs).join(held, "doc_id").groupBy("said", F.col("_toxicity.toxic").alias("found")).count().collect()
    n = {(r.said, r.found): r["count"] for r in counted}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.8
    assert n[1, True] / (n[1, True] + n.get((0, True), 0)) > 0.95


def test_ordinal_weights_are_shared_and_ordered():
    rng = np.random.default_rng(6)
    texts = [{w for w in ("aaa", "bbb", "ccc") if rng.random() < 0.5} for _ in range(3000)]
    score = np.array([2.0 * ("aaa" in t) + 1.0 * ("bbb" in t) for t in texts]) + rng.logistic(size=3000)
    grades = (score > 1).astype(int) + (score > 2.5)
    model = toxicity.fit(texts, grades, 3, ["aaa", "bbb", "ccc"], ridge=0.01, steps=600)
    assert np.allclose([model.weights[w] for w in ("aaa", "bbb", "ccc")], [2, 1, 0], atol=0.3)
    assert np.allclose(model.thresholds, [1, 2.5], atol=0.3)


def test_toxicity_with_odd_rows_and_without_labels(spark):
    docs = docs_of(spark, ODD).withColumnRenamed("n_chars", "toxic")
    for labels in ([], [(0, None), (None, 1), (999, 1)], [(1, 1), (1, 0), (2, 0)]):
        graded = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).grade(docs)
        rows = graded.collect()
        assert len(rows) == len(ODD) and not any(r["_toxicity"].toxic for r in rows)
    assert toxicity.clean(docs, toxicity.Grader(spark, toxicity.Model({}, [40.0, 41.0]))).columns == docs.columns


def test_em_recovers_the_labellers(spark):
    rng = np.random.default_rng(7)
    truth, right = rng.random(40_000) < 0.7, [0.9, 0.8, 0.7, 0.95]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where(rng.random(len(truth)) < a, 1, -1) * np.where(truth, 1, -1)) for a in right], axis=1)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, accuracy, prior = weak_quality.estimate([tuple(map(int, p)) for p in patterns], counts.tolist())
    assert np.allclose(accuracy, right, atol=0.03) and abs(prior - 0.7) < 0.03
    assert ((good[index.reshape(-1)] >= 0.5) == truth).mean() > 0.9


def test_quality_against_labels_it_has_not_seen(spark):
    found = catalog.QUERIES["op4_weak_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "said")
    n = {(r.said, r.keep): r["count"] for r in found.join(labels, "doc_id").groupBy("said", "keep").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97
    assert n[0, False] / (n[0, False] + n[0, True]) > 0.7


def test_quality_of_odd_and_no_rows(spark):
    rows = weak_quality.classify(docs_of(spark, ODD).withColumnRenamed("n_chars", "score")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert weak_quality.classify(docs_of(spark, [])).count() == 0


def test_a_hot_id_and_labels_without_documents_leave_the_sample_whole(spark):
    """The sample is of distinct labelled texts: copies of one row and labels of missing ids take no place in it."""
    hot = [(0, "calm words here", "en", "s", 15)] * 400
    rest = [(i, ("idiot moron " if i % 2 else "kind people ") + chr(97 + i % 26) * (1 + i // 26), "en", "s", 20) for i in range(1, 41)]
    docs = spark.createDataFrame(hot + rest, "doc_id long, text string, lang string, source string, n_chars long").repartition(1)
    labels = spark.createDataFrame([(i, int(0 < i <= 40 and i % 2)) for i in range(2000)], "doc_id long, toxic int")
    grader = toxicity.train(docs, labels, sample_rows=50)
    assert {r.doc_id for r in grader.grade(docs).where("_toxicity.toxic").collect()} == {i for i in range(1, 41) if i % 2}


def test_the_scorers_sample_is_of_distinct_rows(spark, monkeypatch):
    taken, fit = [], weak_quality.fit
    monkeypatch.setattr(weak_quality, "fit", lambda rows, cols, values, target: taken.append((len(target), len(set(rows)))) or fit(rows, cols, values, target))
    texts = ["one row many times over"] * 300 + [f"text number {k}" for k in range(20)]
    found = weak_quality.classify(docs_of(spark, texts, ids=[0] * 300 + list(range(1, 21))), sample_rows=21).collect()
    assert taken == [(21, 21)] and sorted(r.id for r in found) == [0] * 300 + list(range(1, 21))


def slow_counts(text, stops):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_stop_words": sum(w in stops for w in words),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
    }


def slow_votes(text, stops):
    c = slow_counts(text, stops)
    share = lambda a, b: c[a] / c[b] if c[b] else 0.0
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    letters = len(regex.findall(r"\p{L}", text))
    capitals = len(regex.findall(r"\p{Lu}", text)) / letters if letters else 1.0
    return (
        vote(c["n_words"] >= 40, c["n_words"] < 5),
        vote(share("n_symbols", "n_words") < 0.02, share("n_symbols", "n_words") > 0.1),
        vote(share("n_stop_words", "n_words") > 0.1, share("n_stop_words", "n_words") < 0.05),
        vote(share("n_repeat_words", "n_words") < 0.2, share("n_repeat_words", "n_words") > 0.5),
        vote(False, share("n_dup_lines", "n_lines") > 0.4),
        vote(3.5 <= share("word_chars", "n_words") <= 7.0, not 2.0 <= share("word_chars", "n_words") <= 15.0),
        vote(capitals < 0.15, capitals > 0.5),
    )


def slow_em(votes, rounds=200):
    """Document by document: the posterior of good."""
    good = [1 / (1 + math.exp(-2 * sum(v))) for v in votes]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(good) + 2)
        chance = [[{x: 1.0 for x in (-1, 0, 1)} for _ in votes[0]] for _ in range(2)]
        for g, v in zip(good, votes, strict=True):
            for j, x in enumerate(v):
                chance[1][j][x] += g
                chance[0][j][x] += 1 - g
        odds = [math.log(prior / (1 - prior))] * len(votes)
        for i, v in enumerate(votes):
            for j, x in enumerate(v):
                odds[i] += math.log(chance[1][j][x] / sum(chance[1][j].values())) - math.log(chance[0][j][x] / sum(chance[0][j].values()))
        good = [1 / (1 + math.exp(-max(-50, min(50, o)))) for o in odds]
    return good


def slow_scorer(texts, target, steps=150, ridge=1e-5):
    """One text and one feature after the other: a function from a text to P(good)."""
    def shares(text):
        out, tokens = Counter(), text.split()
        for t in sorted(tokens):
            for key in (t, "\0" + slow_shape(t)):
                out[zlib.crc32(key.encode()) >> 14] += 1 / len(tokens)
        return out

    rows = [shares(t) for t in texts]
    names = sorted({b for r in rows for b in r}) + ["bias"]
    w, mean, square = (dict.fromkeys(names, 0.0) for _ in range(3))
    for i in range(1, steps + 1):
        g = {b: ridge * w[b] for b in names}
        for r, t in zip(rows, target, strict=True):
            error = (1 / (1 + math.exp(-(sum(w[b] * v for b, v in r.items()) + w["bias"]))) - t) / len(rows)
            for b, v in r.items():
                g[b] += error * v
            g["bias"] += error
        for b in names:
            mean[b], square[b] = 0.9 * mean[b] + 0.1 * g[b], 0.99 * square[b] + 0.01 * g[b] * g[b]
            w[b] -= 0.3 * (1 - i / (steps + 1)) * (mean[b] / (1 - 0.9**i)) / (math.sqrt(square[b] / (1 - 0.99**i)) + 1e-5)
    return lambda text: 1 / (1 + math.exp(-(sum(w.get(b, 0.0) * v for b, v in shares(text).items()) + w["bias"])))


def slow_shape(token):
    """Runs of letters as a, of numbers as 0, other characters as they are."""
    kind = lambda ch: unicodedata.category(ch)[0] if unicodedata.category(ch)[0] in "LN" else ""
    return "".join({"L": "a", "N": "0"}.get(k) or "".join(run) for k, run in itertools.groupby(token, key=kind))[:8]


def test_weak_quality_equals_a_slow_reading(spark, real):
    """Votes, posteriors and scores of whole real texts and odd ones, from plain Python."""
    texts = [r.text for r in real.orderBy("doc_id").limit(60).collect()] + ODD[:8]
    found = {r.id: r for r in weak_quality.classify(docs_of(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    stops = set(" ".join(quality_rules.STOP_WORDS.values()).split())
    good = slow_em([slow_votes(t, stops) for t in plain])
    scorer = slow_scorer(plain, [round(g, 9) for g in good])
    for i, t in enumerate(plain):
        assert abs(found[i].posterior - good[i]) < 1e-6
        assert abs(found[i].score - scorer(t)) < 1e-4, (i, found[i].score, scorer(t))
        assert found[i].keep == (found[i].score >= 0.5)


def test_columns_named_like_the_graders_stay(spark):
    docs = docs_of(spark, ["calm", None])
    names = ["_score", "_TOXICITY", "_toxicity_", "grade", "a.b"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    kept = toxicity.clean(wide, toxicity.Grader(spark, toxicity.Model({}, [40.0, 41.0])))
    assert kept.columns == wide.columns and all(r[n] == f"{n}{r.doc_id}" for r in kept.collect() for n in names)


def test_scores_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    model = toxicity.Model({"bad-": 0.25, "badword": 1.5, "worse": 0.5}, [1.0, 2.0])
    text = "A BADword, \u00e9t\u00e9; worse-still badwords " * 50
    whole = model.score(text, {})
    monkeypatch.setattr(toxicity, "pieces", lambda t: pieces(t, 9))
    assert model.score(text, {}) == whole and toxicity.words(text) == {"a", "badword", "\u00e9t\u00e9", "worse", "still", "badwords"}


def slow_grades(texts, labels, steps=300, ridge=0.3):
    """The grader of labelled texts, one text and one feature after the other: a function from a text to (severity, grade)."""
    found = [{f for w in re.findall(r"[^\W\d_]+", t.lower()) for f in [w, *(w[:n] + "-" for n in (4, 5, 6) if len(w) >= n)]} for t in texts]
    once = {frozenset(f): y for f, y in reversed(list(zip(found, labels, strict=True)))}
    n1, n0 = sum(once.values()), sum(1 - y for y in once.values())
    names, kept = sorted(set().union(*found)), []
    for name in names:
        a, b = sum(name in f for f, y in once.items() if y), sum(name in f for f, y in once.items() if not y)
        cells = [(a, n1 * (a + b)), (b, n0 * (a + b)), (n1 - a, n1 * (n1 + n0 - a - b)), (n0 - b, n0 * (n1 + n0 - a - b))]
        g = 2 * sum(x * math.log(x * (n1 + n0) / e) for x, e in cells if x)
        if g > 2 * math.log(len(names)) and a * n0 > b * n1:
            kept.append(name)
    words = [set(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    hits = [sum(any(f in kept for f in [w, *(w[:n] + "-" for n in (4, 5, 6) if len(w) >= n)]) for w in ws) for ws in words]
    middle = float(np.median([h for h, y in zip(hits, labels, strict=True) if y]))
    grades = [1 + (h > middle) if y else 0 for h, y in zip(hits, labels, strict=True)]
    sig = lambda x: 1 / (1 + math.exp(-x)) if x > -500 else 0.0
    odds = [(sum(g > j for g in grades) + 0.5) / (sum(g <= j for g in grades) + 0.5) for j in (0, 1)]
    t0, t1 = -math.log(odds[0]), max(-math.log(odds[0]), -math.log(odds[1]) + 0.1)
    state = {**dict.fromkeys(kept, 0.0), 0: t0, 1: math.log(t1 - t0)}
    mean, square = dict.fromkeys(state, 0.0), dict.fromkeys(state, 0.0)
    for i in range(1, steps + 1):
        t = [state[0], state[0] + math.exp(state[1])]
        g = {k: ridge * v if k in kept else 0.0 for k, v in state.items()}
        for f, y in zip(found, grades, strict=True):
            x = sum(state[k] for k in f if k in state)
            bounds = [-40.0, *t, 40.0]
            low, high = sig(bounds[y] - x), sig(bounds[y + 1] - x)
            down, up = low * (1 - low) / (high - low), high * (1 - high) / (high - low)
            for k in f:
                if k in state:
                    g[k] += up - down
            # a lower bound pushes with down, an upper one with -up; both thresholds move with the first
            for bound, push in ((y, down), (y + 1, -up)):
                if bound in (1, 2):
                    g[0] += push
                    g[1] += push * math.exp(state[1]) if bound == 2 else 0.0
        for k in state:
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g[k], 0.99 * square[k] + 0.01 * g[k] * g[k]
            state[k] -= 0.1 * (1 - i / (steps + 1)) * (mean[k] / (1 - 0.9**i)) / (math.sqrt(square[k] / (1 - 0.99**i)) + 1e-6)

    def read(text):
        f = {f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in [w, *(w[:n] + "-" for n in (4, 5, 6) if len(w) >= n)]}
        x = sum(state[k] for k in f if k in state)
        above = [sig(x - state[0]), sig(x - state[0] - math.exp(state[1]))]
        chances = [1 - above[0], above[0] - above[1], above[1]]
        return sum(above), chances.index(max(chances)), above[0] >= 0.5

    return kept, read


def test_toxicity_equals_a_slow_reading(spark):
    """Features, thresholds, severities and grades of small real texts, from plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("length(text) < 1500").orderBy(F.desc("toxic"), "doc_id").limit(120)
    rows = docs.select("doc_id", "text", "toxic").collect()
    kept, read = slow_grades([r.text for r in rows], [r.toxic for r in rows])
    grader = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert len(kept) > 3 and sorted(grader.model.value.weights) == sorted(kept)
    found = {r.doc_id: r["_toxicity"] for r in grader.grade(docs.select("doc_id", "text")).collect()}
    for r in rows:
        severity, grade, toxic = read(r.text)
        assert abs(found[r.doc_id].expected_severity - severity) < 1e-3 and found[r.doc_id].toxic == toxic
        assert found[r.doc_id].grade == grade or abs(severity - round(severity * 2) / 2) < 0.05
