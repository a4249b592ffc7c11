"""Importance resampling against a plain reading, feature by feature."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
from llm_support import ODD, SF, docs_of

from pressloom.llm import catalog, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, targets, percent=5, min_words=20, buckets=10_000):
    """{id: [(n_features, weight, score, rank)]} by plain Python."""
    hashed = [(i, [crc32(f.encode()) % buckets for f in features(t)]) for i, t in docs]
    s = Counter(b for _, bs in hashed for b in bs)
    t = Counter(crc32(f.encode()) % buckets for x in targets for f in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), (_, bs) in zip(docs, hashed, strict=True):
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        rows.append((i, len(words(text)), len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in rows), key=str)


def test_joined_hashes_of_words_of_any_length():
    words_ = [b"a", b"bc" * 30, b"x" * 500, b"\xc3\xa9t\xc3\xa9", b"y" * 48, b"z" * 49, b"q"] * 3
    found, real = resample.feature_hashes(words_, np.arange(len(words_)))
    for i in range(len(words_)):
        for k in range(3):
            assert real[i, k] == (i >= k)
            if i >= k:
                assert found[i, k] == crc32(b" ".join(words_[i - k : i + 1]))


def test_streams_of_small_pieces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 64)
    monkeypatch.setattr(resample, "STREAM", 50)
    import pyarrow as pa

    texts = [*ODD, "one two three four five six seven " * 40, "tail"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    seen = []
    for out in resample.streams(iter([batch, batch]), 10_000):
        row = out.to_pylist()[0]
        stream = np.frombuffer(row["stream"], dtype="<u2")
        for key, n, begin, end in zip(row["ids"], row["n_words"], [0, *row["ends"]], row["ends"], strict=False):
            assert n == len(words(texts[key]))
            assert Counter(stream[begin:end].tolist()) == Counter(crc32(f.encode()) % 10_000 for f in features(texts[key]))
            seen.append(key)
    assert seen == list(range(len(texts))) * 2


def test_odd_rows_ties_and_clashing_columns(spark):
    texts = [*ODD, *("alpha beta gamma delta " * 6 + str(k % 7) for k in range(200))]
    ids = [None, *range(len(texts) - 3), 5, 5]
    docs = docs_of(spark, texts, ids=ids).withColumnsRenamed({"n_chars": "rank", "lang": "_tie_rank"})
    targets = ["gamma delta 3", None, "", "alpha 3"]
    aim = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resample.resample(docs, aim)
    rows = sorted(((r.id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    assert rows == brute(list(zip(ids, texts, strict=True)), targets)
    drawn = {r[0] for r in rows if r[4] is not None}
    kept = resample.take(docs, aim)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn


def test_empty_tables(spark):
    none = docs_of(spark, [])
    some = docs_of(spark, ["word " * 30] * 3)
    assert resample.resample(none, some).count() == 0
    assert {r.weight <= 0 for r in resample.resample(some, none).collect()} == {True}


def test_ranks_over_many_partitions_and_one_tie(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7L, id) as score").repartition(7)
    got = {r.id: r["rank"] for r in resample.ranked(rows, [resample.F.desc("score"), resample.F.asc("id")], "rank").collect()}
    want = sorted(range(5000), key=lambda i: (-(7 if i % 3 == 0 else i), i))
    assert got == {i: k + 1 for k, i in enumerate(want)}


def test_query_against_plain_reading(spark, real):
    rows = sorted((tuple(r) for r in catalog.QUERIES["op11_resample"](spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    targets = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows == brute([(r.doc_id, r.text) for r in real.collect()], targets)
