"""Importance resampling towards a target distribution over hashed word n-grams, by an external sort-count.

A text's features are all its runs of one to three consecutive words; a feature's
bucket is the CRC-32 of its bytes modulo the number of buckets. Every text is read
once: the buckets of many documents are packed into one stream of uint16 with the
documents' offsets, and the streams are written to the shared checkpoint folder.
Counts come from the streams: each is sorted and run-length encoded, and the runs are
added up by bucket. Documents are weighed by a later pass that gathers the buckets'
gains over the same streams and adds them up between offsets.

The draw is one exact ranking of narrow rows over range partitions: no task and no driver
holds all scores. Only the gains, one number a bucket, are sent to the tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.llm.texts import own, pieces
from pressloom.operators.ranks import ranked
from pressloom.session import checkpointed

BUCKETS = 10_000
MOST_BUCKETS = 1 << 16
#: Features after which a stream is closed; only its last document may exceed it.
STREAM = 1 << 20
#: Bytes of texts that are split at once, in which a longer text is one piece after the other.
PIECE = 1 << 20
#: Words of more bytes are hashed together with their neighbours, one by one.
LONGEST = 48
#: Fixed by the contract: a word's bytes are digits, letters and all bytes above 0x7F; only A-Z are lowered.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC with value b becomes, n bytes of text later.

    The CRC of two joined strings is the first one's, so shifted by the second's length,
    with the second one's added (xor). A shift by n+1 is a shift by n and then by one byte.
    """
    one = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        x = b
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        one[b] = x
    tables = np.empty((LONGEST + 2, 4, 256), dtype=np.uint32)
    tables[0] = [np.arange(256, dtype=np.uint32) << 8 * k for k in range(4)]
    for n in range(1, LONGEST + 2):
        tables[n] = tables[n - 1] >> 8 ^ one[tables[n - 1] & 0xFF]
    return tables


_SHIFT = _shift_tables()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = _SHIFT[n, 0, crc & 0xFF]
    for k in (1, 2, 3):
        out ^= _SHIFT[n, k, crc >> 8 * k & 0xFF]
    return out


def feature_hashes(words: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of the one to three words that end at every word: (n x 3 hashes, which of them exist).

    ``place`` is a word's number in its text, from 0, so features keep within texts.
    """
    n = len(words)
    single = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    size = np.fromiter(map(len, words), np.int64, n)
    near = np.minimum(size, LONGEST)
    found = np.zeros((n, 3), dtype=np.uint32)
    found[:, 0] = single
    # a blank and the word, then behind what ends at the word before
    tail = _shifted(np.full(n, zlib.crc32(b" "), dtype=np.uint32), near) ^ single
    for k in (1, 2):
        found[1:, k] = _shifted(found[:-1, k - 1], near[1:] + 1) ^ tail[1:]
    for i in np.flatnonzero(size > LONGEST):
        # every feature in which the long word is not the first; where it is the first, its own hash is shifted
        for j in range(i, min(i + 2, n)):
            for k in range(j - i + 1, 3):
                if j - k >= 0:
                    found[j, k] = zlib.crc32(b" ".join(words[j - k : j + 1]))
    return found, place[:, None] >= np.arange(3)


def _pieces(text: bytes) -> Iterator[tuple[list[bytes], int, int]]:
    """(words, first, fresh): a text's words by pieces, each led by up to two words of the one before; ``first`` numbers its first word in the text, ``fresh`` its first new one."""
    at, before = 0, []
    for piece in pieces(text.translate(_WORD_BYTES), PIECE):
        new = piece.split()
        yield before + new, at - len(before), at
        at += len(new)
        before = (before + new)[-2:]


def streams(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row a stream: ids, words and feature ends of its documents, and their packed buckets."""
    ids, n_words, ends, parts, total = [], [], [], [], 0

    def closed(kind):
        return pa.RecordBatch.from_arrays(
            [pa.array([x], type=t) for x, t in ((ids, pa.list_(kind)), (n_words, pa.list_(pa.int64())), (ends, pa.list_(pa.int64())), (b"".join(parts), pa.large_binary()))],
            names=["ids", "n_words", "ends", "stream"],
        )

    def pack(held):
        """The features of pieces held together, as packed buckets."""
        words = [w for piece, _, _ in held for w in piece]
        if not words:
            return 0
        sizes = np.array([len(piece) for piece, _, _ in held])
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(words)) - starts + np.repeat([first for _, first, _ in held], sizes)
        hashes, real = feature_hashes(words, place)
        real &= (place >= np.repeat([fresh for _, _, fresh in held], sizes))[:, None]
        parts.append((hashes[real] % np.uint32(buckets)).astype("<u2").tobytes())
        return len(parts[-1]) // 2

    for batch in batches:
        kind, held, size = batch.column(0).type, [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            count = 0
            text = (text.as_py() or "").encode()
            for piece in _pieces(text):
                count = piece[1] + len(piece[0])
                held.append(piece)
                size += len(piece[0])
                if size > PIECE >> 3:
                    total += pack(held)
                    held, size = [], 0
            ids.append(key.as_py())
            n_words.append(count)
            # the features of n words: n of one, n-1 of two, n-2 of three
            ends.append((ends[-1] if ends else 0) + max(0, count) + max(0, count - 1) + max(0, count - 2))
            if ends[-1] > STREAM:
                total += pack(held)
                held, size = [], 0
                yield closed(kind)
                ids, n_words, ends, parts, total = [], [], [], [], 0
        if ids:
            total += pack(held)
            if total != ends[-1]:
                raise AssertionError("packed features and offsets differ")
            yield closed(kind)
            ids, n_words, ends, parts, total = [], [], [], [], 0


def packed(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(ids, n_words, ends, stream): the packed streams of ``docs``, written once."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets are numbered by uint16: 1 to {MOST_BUCKETS}")
    narrow = docs.select(own(id_col).alias("id"), own(text_col).cast("string").alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("ids", T.ArrayType(narrow.schema["id"].dataType)), T.StructField("n_words", longs), T.StructField("ends", longs), T.StructField("stream", T.BinaryType())])
    return checkpointed(narrow.mapInArrow(partial(streams, buckets=buckets), schema))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of a task's streams: each sorted and run-length encoded, the runs added up."""
    totals = np.zeros(MOST_BUCKETS, dtype=np.int64)
    for batch in batches:
        for x in batch.column(0):
            stream = np.sort(np.frombuffer(x.as_buffer() or b"", dtype="<u2"))
            if stream.size:
                starts = np.flatnonzero(np.r_[True, stream[1:] != stream[:-1]])
                totals[stream[starts]] += np.diff(np.r_[starts, stream.size])
    seen = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[seen])], names=["bucket", "n"])


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all documents are in each occurring bucket."""
    return streams.select("stream").mapInArrow(_runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A bucket's gain: floor(1000 ln of its smoothed share in the target over that in the source); both given as (bucket, n)."""
    s, t = ([0] * buckets for _ in range(2))
    for counts, table in ((s, source), (t, target)):
        for row in table.collect():  # one row a bucket, at most MOST_BUCKETS
            counts[row.bucket] = row.n
    over, under = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * over) / (float(a + 1) * under))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def noise(key: object, seed: int) -> int:
    """The seeded Gumbel noise of an id, in thousandths; a null id is the empty string."""
    h = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(batches: Iterator[pa.RecordBatch], gains: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    small = gains.astype(np.int32)  # a thousand times the logarithm of a ratio of longs
    for batch in batches:
        for ids, n_words, ends, stream in zip(*batch.columns, strict=True):
            keys = ids.values
            ends = np.asarray(ends.values, dtype=np.int64)
            sizes = np.diff(ends, prepend=0)
            weights = np.zeros(len(ends), dtype=np.int64)
            some = np.flatnonzero(sizes)
            if some.size:
                weights[some] = np.add.reduceat(small[np.frombuffer(stream.as_buffer(), dtype="<u2")], (ends - sizes)[some], dtype=np.int64)
            score = weights + np.array([noise(k, seed) for k in keys.to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([keys, n_words.values, pa.array(sizes), pa.array(weights), pa.array(score)], names=["id", "n_words", "n_features", "weight", "score"])


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row for every row of ``docs``; ``target`` is a table of texts.

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100) of
    highest score are drawn: rank 1, 2, 3 and so on, equal scores by ascending id (null
    first); other rows have a null rank. Null and empty texts have no words and weigh 0.
    Rows that repeat an id have the same noise, and among rows equal in all of it the
    order is open. An empty target gives only negative or zero gains; an empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    source = packed(docs, buckets, id_col, text_col)
    aim = packed(target.select(F.lit(0).alias("id"), own(target_text_col).alias("text")), buckets, "id", "text")
    gain = gains(bucket_counts(source), bucket_counts(aim), buckets)
    kind = source.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    scored = checkpointed(source.mapInArrow(partial(_weighed, gains=gain, seed=seed), schema))
    fit = F.col("n_words") >= min_words
    enough = scored.where(fit)
    most = percent * enough.count() // 100
    in_order = ranked(enough, [F.desc("score"), F.asc("id")], "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return in_order.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def take(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, all columns as they are; a null id is an id like any other."""
    drawn = resample(docs, target, id_col=id_col, **options).where("rank is not null").select(F.col("id").alias("_drawn_id")).distinct()
    return docs.join(drawn, own(id_col).eqNullSafe(F.col("_drawn_id")), "left_semi")
