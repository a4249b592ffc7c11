"""Quality from weak labels: labellers' accuracies by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristics vote good (1), bad (-1) or nothing (0) on every document, as
built-in expressions. The documents are counted by vote pattern, of which there are at
most 3^labellers; these counts, over all documents, are all that
expectation-maximisation needs to estimate how often each labeller votes what on good and
bad documents, and each pattern's posterior. The posteriors of a bounded sample train a
linear scorer over hashed token frequencies, which then scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm import quality_rules
from pressloom.llm.texts import pieces
from pressloom.session import checkpointed

#: Documents that the scorer is fitted on, those of the smallest seeded hash, whole texts.
SAMPLE_ROWS = 4_000
MOST_LABELLERS = 8
BITS = 18
#: Tokens whose features a worker remembers; cleared beyond.
REMEMBERED = 100_000
#: Repeated rows that are given back at once.
REPEATS = 1 << 16


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def labellers(text: Column, counts: str = "_counts") -> dict[str, Column]:
    """The heuristics, over a text and its counts from ``quality_rules.metrics``."""
    c = F.col(counts)
    share = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    upper = F.length(F.regexp_replace(text, F.lit(r"[^\p{Lu}]+"), F.lit("")))
    letters = F.length(text) - F.length(F.regexp_replace(text, F.lit(r"\p{L}+"), F.lit("")))
    capitals = F.when(letters > 0, upper / letters).otherwise(F.lit(1.0))
    return {
        "length": _vote(c["n_words"] >= 40, c["n_words"] < 5),
        "symbols": _vote(share("n_symbols", "n_words") < 0.02, share("n_symbols", "n_words") > 0.1),
        "stop_words": _vote(share("n_stop_words", "n_words") > 0.1, share("n_stop_words", "n_words") < 0.05),
        "repeats": _vote(share("n_repeat_words", "n_words") < 0.2, share("n_repeat_words", "n_words") > 0.5),
        "lines": _vote(F.lit(False), share("n_dup_lines", "n_lines") > 0.4),
        "word_length": _vote(share("word_chars", "n_words").between(3.5, 7.0), ~share("word_chars", "n_words").between(2.0, 15.0)),
        "capitals": _vote(capitals < 0.15, capitals > 0.5),
    }


def estimate(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, accuracy by labeller, share of good) by expectation-maximisation.

    Starts from the votes' majority, so that "good" keeps its meaning. A labeller's
    accuracy is the chance that a vote of its is right. All counts are smoothed by one.
    """
    if not patterns:
        return np.zeros(0), np.zeros(0), 0.5
    votes = np.array(patterns, dtype=np.int64)
    n = np.array(counts, dtype=float)
    good = 1 / (1 + np.exp(-2.0 * votes.sum(1)))
    accuracy, prior = np.zeros(votes.shape[1]), 0.5
    for _ in range(rounds):
        weights = np.stack([n * (1 - good), n * good])
        prior = float((weights[1].sum() + 1) / (n.sum() + 2))
        # table[class, labeller, vote + 1]
        table = np.stack([[np.bincount(v + 1, w, 3) + 1 for v in votes.T] for w in weights])
        right = table[1, :, 2] + table[0, :, 0]
        accuracy = right / (right + table[1, :, 0] + table[0, :, 2])
        table = np.log(table / table.sum(2, keepdims=True))
        odds = np.log(prior / (1 - prior)) + sum(table[1, j, votes[:, j] + 1] - table[0, j, votes[:, j] + 1] for j in range(votes.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return good, accuracy, prior


_SHAPES = [(regex.compile(p), r) for p, r in ((r"\p{L}+", "a"), (r"\p{N}+", "0"))]


def shape(token: str) -> str:
    """A token's form: runs of letters and digits as one character each, others as they are, at most 8 characters."""
    for pattern, one in _SHAPES:
        token = pattern.sub(one, token)
    return token[:8]


def buckets(token: str) -> tuple[int, int]:
    """The hashed features of a token: the token itself and its shape."""
    return zlib.crc32(token.encode()) >> 32 - BITS, zlib.crc32(b"\0" + shape(token).encode()) >> 32 - BITS


def shares(text: str | None, known: dict[str, tuple[int, int]]) -> dict[int, float]:
    """A text's feature buckets with their share of its tokens, summed in token order; none for a text without tokens."""
    counts, found = Counter(), {}
    for piece in pieces(text or ""):
        counts.update(piece.split())
    total = max(1, sum(counts.values()))
    for token in sorted(counts):
        if len(known) > REMEMBERED:
            known.clear()
        for bucket in known.get(token) or known.setdefault(token, buckets(token)):
            found[bucket] = found.get(bucket, 0.0) + counts[token] / total
    return found


def features(text: Column | str) -> Column:
    """``shares`` of whole texts, array of (bucket, share): at most 2^BITS of a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, int]] = {}
        for texts in batches:
            yield pa.array([[{"bucket": b, "share": v} for b, v in shares(t.as_py(), known).items()] for t in texts], pa.list_(pa.struct({"bucket": pa.int32(), "share": pa.float64()})))

    return F.arrow_udf(run, "array<struct<bucket:int,share:double>>")(text)


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, steps: int = 150, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights by bucket, bias) of the logistic scorer for soft targets, by Adam steps of falling size.

    rows, cols, values: the features of the fitted texts, by text number and bucket.
    """
    n, w, bias = max(1, len(target)), np.zeros(1 << BITS), 0.0
    seen, cols = np.unique(cols, return_inverse=True) if len(cols) else (np.zeros(0, np.int64), cols)
    own = np.zeros(len(seen) + 1)
    mean, square = np.zeros_like(own), np.zeros_like(own)
    for i in range(1, steps + 1):
        score = np.bincount(rows, own[cols] * values, minlength=len(target)) + own[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - target) / n
        g = np.append(np.bincount(cols, error[rows] * values, minlength=len(seen)), error.sum()) + ridge * own
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        own = own - 0.3 * (1 - i / (steps + 1)) * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-5)
    w[seen], bias = own[:-1], float(own[-1])
    return w, bias


def score(text: Column | str, weights, bias: float) -> Column:
    """P(good) of whole texts by a broadcast weight table; null, empty and blank texts have the bias alone."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, known = weights.value, {}

        def of(text: str | None) -> float:
            total, n = 0.0, 0
            for piece in pieces(text or ""):
                if len(known) > REMEMBERED:
                    known.clear()
                tokens = piece.split()
                n += len(tokens)
                for token in tokens:
                    value = known.get(token)
                    if value is None:
                        a, b = buckets(token)
                        value = known[token] = float(table[a] + table[b])
                    total += value
            return total / n if n else 0.0

        for texts in batches:
            out = bias + np.array([of(t.as_py()) for t in texts], float)
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))), pa.float64())

    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", votes: Mapping[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, posterior, score, keep): the labellers' posterior, the scorer's P(good), and whether that is 1/2 or more.

    votes: {name: column of -1, 0 or 1 over ``text`` and ``_counts``}, at most MOST_LABELLERS.
    The texts are read three times: once for the votes, which are written as one row of
    (id, text hash, pattern) a document, once for the few sampled ones, once for the scores.
    Null texts count as empty, null ids are an id. Rows are kept as they are, repeated
    ones too. An empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = list((votes if votes is not None else labellers(F.col("text"))).values())
    if not 1 <= len(columns) <= MOST_LABELLERS:
        raise ValueError(f"1 to {MOST_LABELLERS} labellers")
    pattern = sum(((c.cast("int") + 1) * 3**j for j, c in enumerate(columns)), F.lit(0)).alias("pattern")
    digest = F.xxhash64("text").alias("text_hash")
    voted = checkpointed(quality_rules.metrics(own).select("id", digest, pattern))
    counted = sorted((r.pattern, r.n) for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect())  # at most 3^MOST_LABELLERS rows
    good, _, _ = estimate([tuple(p // 3**j % 3 - 1 for j in range(len(columns))) for p, _ in counted], [n for _, n in counted])
    posterior = {p: float(round(g, 9)) for (p, _), g in zip(counted, good, strict=True)}
    place = F.xxhash64("id", "text_hash")
    sample = voted.groupBy("id", "text_hash").agg(F.first("pattern").alias("pattern")).orderBy(place, "id", "text_hash").limit(sample_rows)
    met = own.withColumn("text_hash", digest).join(F.broadcast(sample.withColumnRenamed("id", "_id").withColumnRenamed("text_hash", "_hash")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))  # at most sample_rows rows
    picked = met.groupBy("id", "text_hash").agg(F.first("pattern").alias("pattern"), F.first("text").alias("text"))
    fitted = picked.select("id", "text_hash", "pattern", features("text").alias("f")).orderBy("id", "text_hash").select("pattern", "f.bucket", "f.share").toArrow()
    flat = [fitted[c].combine_chunks() for c in ("bucket", "share")]
    rows = np.repeat(np.arange(len(fitted)), pc.list_value_length(flat[0]).to_numpy(zero_copy_only=False))
    weights, bias = fit(rows, flat[0].flatten().to_numpy().astype(np.int64), flat[1].flatten().to_numpy(), np.array([posterior[p] for p in fitted["pattern"].to_pylist()]))
    scored = own.select("id", digest, F.round(score("text", spark.sparkContext.broadcast(weights.astype(np.float32)), bias), 9).alias("score"))
    # equal (id, text) pairs have equal votes and scores, so both sides meet as one row a pair and are repeated afterwards
    sides = voted.select("id", "text_hash", "pattern", F.lit(None).cast("double").alias("score"), F.lit(0).alias("n")).unionByName(
        scored.select("id", "text_hash", F.lit(None).cast("int").alias("pattern"), "score", F.lit(1).alias("n"))
    )
    paired = sides.groupBy("id", "text_hash").agg(F.max("pattern").alias("pattern"), F.max("score").alias("score"), F.sum("n").alias("n"))
    table = spark.createDataFrame(sorted(posterior.items()), "pattern int, posterior double")
    every = paired.join(F.broadcast(table), "pattern")  # at most 3^MOST_LABELLERS rows
    blocks = every.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {REPEATS}"))))
    repeats = blocks.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS), F.col("n") - F.col("block") * REPEATS))))
    return repeats.select("id", "posterior", "score", (F.col("score") >= 0.5).alias("keep"))
