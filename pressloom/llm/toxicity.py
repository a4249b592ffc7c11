"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

A text's features are its distinct lower-cased words and their beginnings. With
weights w shared by all thresholds t1 < t2 < ..., P(grade > k) = s(w.x - t(k+1)) for the
logistic function s; the expected severity is the sum of these over k. The model
is fitted on a bounded sample of labelled rows on the driver and is a table of the
weights of the features that tell toxic rows from others in it, which is broadcast;
every row is then scored in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.texts import free_name, pieces
from pressloom.session import checkpointed

#: Labelled texts that a fit takes, those (id, text) pairs of the smallest seeded hash, whole texts.
SAMPLE_ROWS = 4_000
#: Lengths of the word beginnings that are features.
STEMS = (4, 5, 6)
#: Words whose weights a worker remembers; cleared beyond.
REMEMBERED = 100_000
_WORD = regex.compile(r"\p{L}+")


def words(text: str | None) -> set[str]:
    return {w for piece in pieces(text or "") for w in _WORD.findall(piece.lower())}


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]


@dataclass
class Model:
    """weights by feature; thresholds, one fewer than grades, ascending."""

    weights: dict[str, float]
    thresholds: list[float]

    def score(self, text: str | None, known: dict[str, float]) -> float:
        """w.x of one whole text: the weights of its distinct words, summed in order."""
        met: dict[str, float] = {}
        for piece in pieces(text or ""):
            if len(known) > REMEMBERED:
                known.clear()
            for word in set(_WORD.findall(piece.lower())):
                value = known.get(word)
                if value is None:
                    value = known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
                if value:
                    met[word] = value
        return sum(met[word] for word in sorted(met))


def _log1pexp(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-_log1pexp(-x))


def _features(words: Column) -> Column:
    """The distinct ``features`` of an array of words."""
    of = lambda w: F.array_compact(F.array(w, *(F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("-"))) for n in STEMS)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def telling(sample: DataFrame) -> list[str]:
    """The features of sample(id, label, words) whose presence depends on the label, the strongest first.

    A feature is kept if its likelihood-ratio statistic exceeds 2 log(features), by
    which about one of them would pass by chance, and toxic texts have it more often.
    Equal word sets count once, by the label of the smallest id. Features are counted on Spark.
    """
    once = checkpointed(sample.groupBy("words").agg(F.min_by("label", "id").alias("label")))
    n1, n = once.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    n0 = n - n1
    if not n1 or not n0:
        return []
    counted = once.select("label", F.explode(_features(F.col("words"))).alias("f")).groupBy("f").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    counted = checkpointed(counted)
    a, b, met = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    cells = ((a, n1 * met), (b, n0 * met), (n1 - a, n1 * (n - met)), (n0 - b, n0 * (n - met)))
    g = 2 * sum((F.when(x > 0, x * F.log(x * n / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    least = 2 * math.log(max(2, counted.count()))
    return [r.f for r in counted.withColumn("g", g).where((F.col("g") > least) & (a * n0 > b * n1)).orderBy(F.desc("g"), "f").select("f").collect()]


def severities(hits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades for 0/1 labels: 0 where not toxic, else 2 for texts with more telling words than the median toxic text, else 1."""
    middle = np.median(hits[toxic]) if toxic.any() else 0
    return np.where(toxic, 1 + (hits > middle), 0)


def fit(texts: list[Iterable[str]], grades: np.ndarray, n_grades: int, kept: list[str], ridge: float = 0.3, steps: int = 300) -> Model:
    """Maximum likelihood for texts given by their features, with a ridge on the weights of the features ``kept``, by Adam steps of falling size."""
    index = {f: i for i, f in enumerate(kept)}
    columns = [sorted({index[f] for f in t if f in index}) for t in texts]
    rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    cols = np.array([c for own in columns for c in own], dtype=np.int64)
    n, d, k = len(texts), len(kept), n_grades - 1
    odds = np.array([((grades > j).sum() + 0.5) / ((grades <= j).sum() + 0.5) for j in range(k)])
    first = np.maximum.accumulate(-np.log(odds) + 0.1 * np.arange(k))
    # thresholds are the first and the logarithms of the steps up from it, so they stay in order
    state = np.concatenate([np.zeros(d), first[:1], np.log(np.diff(first))])

    def thresholds(state: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([state[d : d + 1], np.exp(state[d + 1 :])]))

    def gradient(state: np.ndarray) -> np.ndarray:
        bounds = np.concatenate([[-40.0], thresholds(state), [40.0]])
        score = np.bincount(rows, state[cols], minlength=n)
        low, high = _sigmoid(bounds[grades] - score), _sigmoid(bounds[grades + 1] - score)
        chance = np.maximum(high - low, 1e-12)
        down, up = low * (1 - low) / chance, high * (1 - high) / chance
        by_bound = np.bincount(grades, down, k + 2)[: k + 2] - np.bincount(grades + 1, up, k + 2)[: k + 2]
        inner = by_bound[1 : k + 1]
        steps_up = np.cumsum(inner[::-1])[::-1]
        steps_up[1:] *= np.exp(state[d + 1 :])
        weights = np.bincount(cols, (up - down)[rows], minlength=d) + ridge * state[:d]
        return np.concatenate([weights, steps_up])

    mean, square = np.zeros_like(state), np.zeros_like(state)
    for i in range(1, steps + 1 if n else 1):
        g = gradient(state)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        state = state - 0.1 * (1 - i / (steps + 1)) * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-6)
    return Model({f: float(x) for f, x in zip(kept, state[:d], strict=True)}, thresholds(state).tolist())


class Grader:
    """Column functions of one fitted model, sent to the executors once."""

    def __init__(self, spark: SparkSession, model: Model):
        self.model = spark.sparkContext.broadcast(model)

    def score(self, text: Column | str) -> Column:
        """w.x of whole texts; null and empty texts have no features and score 0."""
        model = self.model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, float] = {}
            for texts in batches:
                yield pa.array([model.value.score(t.as_py(), known) for t in texts], pa.float64())

        return F.arrow_udf(run, "double")(text)

    def grade(self, docs: DataFrame, text_col: str = "text", out: str = "_toxicity") -> DataFrame:
        """``docs`` with expected_severity (double), grade (int, the likeliest, ties to the lower) and toxic (boolean) as a struct ``out``.

        toxic is P(grade > 0) >= 1/2. Rows are kept as they are, repeated ones too; equal
        texts have equal grades; null and empty texts score 0. A column named ``out`` is
        replaced, all others stay whatever their names. An empty table gives no rows.
        """
        name = free_name(docs, "_score")
        score = F.col(name)
        above = [1 / (1 + F.exp(F.lit(t) - score)) for t in self.model.value.thresholds]
        chances = [a - b for a, b in zip([F.lit(1.0), *above], [*above, F.lit(0.0)], strict=True)]
        likeliest = F.array_position(F.array(*chances), F.array_max(F.array(*chances))) - 1
        found = F.struct(F.round(sum(above), 9).alias("expected_severity"), likeliest.cast("int").alias("grade"), (above[0] >= 0.5).alias("toxic"))
        return docs.withColumn(name, self.score(text_col)).withColumn(out, found).drop(name)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grader:
    """A grader fitted on at most ``sample_rows`` distinct labelled (id, text) pairs of ``docs``, those of the smallest seeded hash.

    labels(id_col, label_col): rows with a null id or label, and ids without a text, are
    not used; an id labelled twice counts as toxic if one label says so. Without labels
    of both kinds no feature has a weight and no row is toxic.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"), F.col(text_col).alias("_text"))
    sample = read.select("_id", "_hash").join(known, "_id").groupBy("_id", "_hash").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id", "_hash"), "_id", "_hash").limit(sample_rows)

    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(words(t.as_py())) for t in texts], pa.list_(pa.string()))

    picked = read.join(F.broadcast(sample), ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.first("_label").alias("label"), F.first("_text").alias("_text"))  # at most sample_rows rows
    worded = checkpointed(picked.select(F.col("_id").alias("id"), "_hash", "label", F.arrow_udf(distinct, "array<string>")("_text").alias("words")))
    kept = telling(worded)
    if not kept:
        return Grader(spark, Model({}, [40.0, 41.0]))
    # only the telling features of the sampled texts reach the driver
    own = F.array(*map(F.lit, kept))
    telling_words = F.size(F.filter("words", lambda w: F.arrays_overlap(_features(F.array(w)), own)))
    rows = worded.select("id", "_hash", "label", F.array_intersect(_features(F.col("words")), own).alias("f"), telling_words.alias("hits")).orderBy("id", "_hash").collect()
    toxic = np.array([bool(r.label) for r in rows], dtype=bool)
    return Grader(spark, fit([r.f for r in rows], severities(np.array([r.hits for r in rows]), toxic), 3, kept))


def clean(docs: DataFrame, grader: Grader, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, repeated ones too, all columns as they are; null and empty texts stay unless the model's bias alone is toxic."""
    out = free_name(docs, "_toxicity")
    return grader.grade(docs, text_col, out).where(~F.col(out)["toxic"]).drop(out)
