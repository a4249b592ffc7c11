"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text becomes a 64-bit SimHash of its word shingles. Fingerprints within
``radius`` differing bits are linked. The search is exact: bit i carries a nonzero
vector m(i) of radius+1 bits, and for each nonzero vector v one table keeps the
bits with <m(i), v> = 1. The differing bits of a pair span at most ``radius``
dimensions, so some v is orthogonal to all of them, and in that table the pair has
equal keys. A table keeps about half the bits, so unrelated fingerprints rarely meet.

Texts that share four fifths of their shingles differ in about ten of 64 bits, which
no affordable covering reaches. ``similar=True`` therefore adds a second pass: bands of
shingle minima bring such texts together, SimHashes of WIDE bits leave out what is far
from it, and the distinct shingles of the rest are compared exactly.

Work is done on distinct fingerprints, so exact copies cost one row each in a
combining aggregate, and fingerprints of very many rows are met by broadcast. Buckets are read from a sorted shuffle as a stream; one that
exceeds ``BLOCK`` fingerprints is not compared in its task but handed on in blocks,
and all pairs of blocks are then compared in tasks of their own: N fingerprints of one
bucket are (N / BLOCK)^2 / 2 such tasks. Neither step
gathers a bucket, and both emit spanning links rather than pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.components import connected_components
from pressloom.llm.joins import join_skewed
from pressloom.llm.texts import free_name, pieces
from pressloom.session import checkpointed

SEED = 42
#: Fingerprints of one bucket that one task compares; larger buckets go by pairs of blocks.
BLOCK = 2048
#: The second pass: a pair with a shingle similarity of 0.8 meets in a band with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.998.
BANDS, ROWS = 12, 4
#: Bits of the second pass's SimHash, and how many may differ in a candidate: 78 are expected at a similarity of 0.8, +-8.
WIDE, WIDE_RADIUS = 512, 110
#: A candidate is linked if its shared shingles are this fraction of all its shingles, or more.
SIMILAR = (4, 5)
#: Shingles of about one block of candidates, besides BLOCK texts.
HELD = 1 << 22
_CHUNK = 1 << 12

_draw = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
_FLIP, _ODD, _MIX = _draw[0] * np.uint64(2), _draw[1] * np.uint64(2) + np.uint64(1), _draw[2] * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of one whole text, in order, repeats included; none for a text without words.

    Long texts are read by pieces, each with the last words of the one before it.
    """
    digest, parts, carried = xxhash.xxh64_intdigest, [], []
    for piece in pieces((text or "").encode("utf-8", "surrogatepass")):
        found = carried + piece.lower().split()
        n = len(found)
        if n >= words:
            joined = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: n - words + 1]
            ends = ends[words - 1 :]
            hashes = np.zeros(len(starts), "<u8")
            for at in range(0, len(starts), _CHUNK):
                pairs = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
                hashes[at : at + _CHUNK] = [digest(joined[s:e], seed) for s, e in pairs]
            parts.append(hashes)
        carried = found[n - words + 1 :] if n >= words else found
    if not parts:
        return np.array([digest(b" ".join(carried), seed)] if carried else [], "<u8")
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Rows of one unsigned long drawn out to WIDE bits."""
    k = WIDE // 64
    mixed = (hashes ^ _FLIP[:k]) * _MIX[:k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[:k]
    return mixed ^ (mixed >> np.uint64(29))


def majority(hashes: np.ndarray, draw=np.ascontiguousarray, k: int = 1) -> np.ndarray:
    """For rows of which ``draw`` makes k unsigned longs each, k unsigned longs: a bit is 1 if set in over half the rows."""
    counts = np.zeros(64 * k, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = draw(hashes[at : at + _CHUNK])
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def simhash(text: str | None, words: int, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one whole text; 0 for a text without words."""
    return int(majority(shingle_hashes(text, words, seed).reshape(-1, 1))[0])


def fingerprint(text: Column | str, words: int = 4, seed: int = SEED) -> Column:
    """The SimHash of a text column as a long with the same 64 bits.

    Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased; shingles
    are ``words`` words joined by single spaces, repeats included. A shorter text is
    one shingle; a null, empty or blank text has fingerprint 0.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), words, seed) for t in texts], dtype=np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(run, "long")(text)


def _outline(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(band keys, WIDE-bit SimHash) of a text's distinct shingles, of which there is one at least."""
    distinct = np.unique(hashes)
    lows = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), _CHUNK):
        lows = np.minimum(lows, ((distinct[at : at + _CHUNK, None] ^ _FLIP) * _ODD).min(0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in lows.reshape(BANDS, ROWS)]
    return np.array(keys, np.uint64).view(np.int64), majority(distinct.reshape(-1, 1), _mixed, WIDE // 64).tobytes()


def outlines(text: Column | str, words: int, seed: int = SEED) -> Column:
    """struct(fp, bands, wide, shingles) of a text column: ``fingerprint``, and what the second pass reads, null for a text without words.

    ``shingles`` is their number with repeats.
    """

    def run(texts: pa.Array) -> pa.Array:
        hashes = [shingle_hashes(t.as_py(), words, seed) for t in texts]
        fps = np.array([majority(h.reshape(-1, 1))[0] for h in hashes], np.uint64).view(np.int64)
        drawn = [_outline(h) if len(h) else (None, None) for h in hashes]
        columns = [pa.array(fps, pa.int64()), pa.array([b for b, _ in drawn], pa.list_(pa.int64())), pa.array([w for _, w in drawn], pa.binary()), pa.array([len(h) for h in hashes], pa.int64())]
        return pa.StructArray.from_arrays(columns, names=["fp", "bands", "wide", "shingles"])

    return F.arrow_udf(run, "struct<fp:bigint,bands:array<bigint>,wide:binary,shingles:bigint>")(text)


def shingle_set(text: Column | str, words: int, seed: int = SEED) -> Column:
    """The distinct shingle hashes of whole texts, ascending, as the bytes of unsigned longs."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_py(), words, seed)).tobytes() for t in texts], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets of hashes have a Jaccard similarity of SIMILAR or more, exactly."""
    part, whole = SIMILAR
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return whole * shared >= part * (len(a) + len(b) - shared)


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering family's bit masks, as signed longs."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(bits)]
    unsigned = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in unsigned]


def _bits(fps: np.ndarray, wide: list[bytes | None]) -> np.ndarray:
    """What is compared, a row of unsigned longs each: the wide fingerprints where there are any, else the fingerprints."""
    if len(wide) and wide[0] is not None:
        return np.frombuffer(b"".join(wide), "<u8").reshape(len(fps), -1)
    return fps.view(np.uint64).reshape(-1, 1)


def _spanning(fps: np.ndarray, bits: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest, (from, to), of the fingerprints under links of ``radius`` differing ``bits`` or fewer."""
    ends = ([], [])
    todo, fresh = np.arange(len(fps)), []
    while len(todo):
        if not fresh:
            fresh, todo = [todo[0]], todo[1:]
        at = fresh.pop()
        near = np.bitwise_count(bits[todo] ^ bits[at]).sum(1, dtype=np.int64) <= radius
        hits, todo = todo[near], todo[~near]
        ends[0].extend([int(fps[at])] * len(hits))
        ends[1].extend(fps[hits].tolist())
        fresh += hits.tolist()
    return ends


_FOUND = "a long, b long, t int, key long, block long, wide binary"


def _found(a=(), b=None, bucket=(0, 0), block=None, bits=None) -> pa.RecordBatch:
    """Links (a, b), or with no b the fingerprints of one block of a large bucket."""
    n = len(a)
    wide = [None] * n if bits is None or bits.shape[1] == 1 else [x.tobytes() for x in bits]
    columns = [(a, pa.int64()), ([None] * n if b is None else b, pa.int64()), ([int(bucket[0])] * n, pa.int32()), ([int(bucket[1])] * n, pa.int64()), ([block] * n, pa.int64()), (wide, pa.binary())]
    return pa.record_batch([pa.array(x, kind) for x, kind in columns], names=["a", "b", "t", "key", "block", "wide"])


def _scan(radius: int):
    """Streams rows (t, key, fp, wide) sorted by bucket (t, key): each bucket's links, or the blocks of one over BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, block = None, [], 0, 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])

        def close() -> Iterator[pa.RecordBatch]:
            if size and (block or size > 1):
                fps, bits = joined()
                yield _found(fps, bucket=bucket, block=block, bits=bits) if block else _found(*_spanning(fps, bits, radius))

        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            bits = _bits(fp, batch.column(3).to_pylist())
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            # buckets of two that lie inside the batch are compared all at once; those of one have no link
            two = starts[1:-1][(stops - starts)[1:-1] == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64) <= radius]
            if len(two):
                yield _found(fp[two], fp[two + 1])
            runs = np.flatnonzero(stops - starts > 2)
            for k in np.unique(np.concatenate(([0], runs, [len(starts) - 1]))):
                at, stop = starts[k], stops[k]
                if bucket != (now := (t[at], key[at])):
                    yield from close()
                    bucket, held, size, block = now, [], 0, 0
                while at < stop:
                    if size == BLOCK:
                        fps, own = joined()
                        yield _found(fps, bucket=bucket, block=block, bits=own)
                        held, size, block = [], 0, block + 1
                    end = min(stop, at + BLOCK - size)
                    held.append((fp[at:end].copy(), bits[at:end].copy()))
                    size, at = size + end - at, end
        yield from close()

    return run


def _blocks(radius: int):
    """Streams rows (t, key, i, j, fp, wide) sorted by the first four: spanning links of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, wide = None, [], []

        def links_of() -> pa.RecordBatch:
            fps = np.array(held, np.int64)
            return pa.record_batch([pa.array(x, pa.int64()) for x in _spanning(fps, _bits(fps, wide), radius)], names=["a", "b"])

        for batch in batches:
            *keys, fps, wides = (c.to_pylist() for c in batch.columns)
            for *now, fp, w in zip(*keys, fps, wides, strict=True):
                if now != pair:
                    if held:
                        yield links_of()
                    pair, held, wide = now, [], []
                held.append(fp)
                wide.append(w)
        if held:
            yield links_of()

    return run


def _linked(probes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links within ``radius`` bits that connect what meets in the buckets of ``probes(t, key, fp, wide)``."""
    dealt = probes.repartition("t", "key").sortWithinPartitions("t", "key")
    found = checkpointed(dealt.mapInArrow(_scan(radius), _FOUND))
    direct = found.where("b is not null").select("a", "b")
    late = found.where("b is null")
    if late.isEmpty():
        return direct
    last = late.groupBy("t", "key").agg(F.max("block").alias("last"))
    pairs = (
        late.join(last, ["t", "key"])
        .select("t", "key", F.col("a").alias("fp"), "wide", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
        .select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "wide")
        .repartition("t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j")
    )
    return direct.unionByName(pairs.mapInArrow(_blocks(radius), "a long, b long"))


def links(fingerprints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that connect exactly the distinct ``fp`` values within ``radius`` bits, directly or by steps."""
    table = masks(radius)
    one = F.element_at(F.array(*[F.lit(m) for m in table]), F.col("t") + 1)
    probes = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(table) - 1))).alias("t"))
    return _linked(probes.select(F.col("t").cast("int").alias("t"), F.col("fp").bitwiseAND(one).alias("key"), "fp", F.lit(None).cast("binary").alias("wide")), radius)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (root, slice, rest, fp, text_hash, hashes) sorted by the first three, the pivot first: whether each text is similar to it."""
    now, pivot, own = None, None, None
    for batch in batches:
        out = []
        for root, part, rest, fp, text_hash, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = np.frombuffer(hashes, "<u8")
            if now != (root, part):
                assert not rest
                now, pivot, own = (root, part), fp, held
            elif rest:
                out.append((root, text_hash, pivot, fp, similar(own, held)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, [pa.int64()] * 4 + [pa.bool_()], strict=True)], names=["root", "text_hash", "a", "b", "near"])


def _judged(fps: list[int], bits: np.ndarray, sets: list[np.ndarray], far: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """(from, to): links of similar texts that connect the ``far`` ones among themselves and with the others, which are connected already."""
    ends = ([], [])
    todo, near = np.flatnonzero(far), np.flatnonzero(~far)
    fresh, joined = [], False

    def put(a: int, b: int) -> None:
        ends[0].append(fps[a])
        ends[1].append(fps[b])

    while len(todo) or fresh:
        if not fresh:
            fresh, todo, joined = [todo[0]], todo[1:], False
        at = fresh.pop()
        apart = np.bitwise_count(bits[todo] ^ bits[at]).sum(1, dtype=np.int64)
        hit = np.array([d <= radius and similar(sets[at], sets[k]) for k, d in zip(todo, apart, strict=True)], bool)
        for k in todo[hit]:
            put(at, k)
        fresh, todo = fresh + todo[hit].tolist(), todo[~hit]
        if not joined and len(near):
            apart = np.bitwise_count(bits[near] ^ bits[at]).sum(1, dtype=np.int64)
            for k in np.argsort(apart, kind="stable"):
                if apart[k] > radius:
                    break
                if similar(sets[at], sets[near[k]]):
                    put(at, near[k])
                    joined = True
                    break
    return ends


def _judge(radius: int):
    """Streams rows (root, i, j, far, fp, wide, hashes) sorted by the first three: the links of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []

        def links_of() -> pa.RecordBatch:
            far, fps, wide, hashes = zip(*held, strict=True)
            found = _judged(fps, _bits(np.array(fps, np.int64), list(wide)), [np.frombuffer(h, "<u8") for h in hashes], np.array(far, bool), radius)
            return pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

        for batch in batches:
            for root, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != pair:
                    if held:
                        yield links_of()
                    pair, held = (root, i, j), []
                held.append(row)
        if held:
            yield links_of()

    return run


def similar_links(outlined: DataFrame, texts: DataFrame, words: int, radius: int = WIDE_RADIUS) -> DataFrame:
    """(a, b): links of similar texts that connect the ``fp`` of outlined(text_hash, fp, bands, wide, shingles), whose texts(text_hash, text) are.

    Candidates share a band and differ in ``radius`` bits of WIDE or fewer. Within each
    of their components every text is compared with one pivot, in slices of about BLOCK
    texts or HELD shingles; where texts are left, these are compared with each other and
    with the pivot's, by pairs of blocks. Only ``similar`` makes a link.
    """
    some = outlined.where("wide is not null").select("text_hash", "fp", "bands", "wide", "shingles").distinct()
    candidates = connected_components(_linked(some.select(F.posexplode("bands").alias("t", "key"), "fp", "wide"), radius)).withColumnRenamed("node", "fp")
    met = checkpointed(some.join(candidates, "fp").select("root", "fp", "text_hash", "wide", "shingles"))
    parts = lambda rows, size: F.ceil(F.greatest(rows / F.lit(BLOCK), size / F.lit(HELD)))
    sizes = checkpointed(met.groupBy("root").agg(parts(F.count("*"), F.sum("shingles")).alias("slices"), F.min(F.struct("fp", "text_hash")).alias("pivot"), F.count("*").alias("n")))
    laid = join_skewed(met, sizes, "root", "n", met.count()).withColumn("rest", F.struct("fp", "text_hash") != F.col("pivot")).drop("pivot")
    wanted = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    hashed = checkpointed(laid.join(wanted, "text_hash").withColumn("hashes", shingle_set("text", words)).drop("text"))
    own = F.when(F.col("rest"), F.array(F.pmod("text_hash", "slices"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    dealt = hashed.select("root", F.explode(own).alias("slice"), "rest", "fp", "text_hash", "hashes").repartition("root", "slice").sortWithinPartitions("root", "slice", "rest")
    judged = checkpointed(dealt.mapInArrow(_stars, "root long, text_hash long, a long, b long, near boolean"))
    direct = judged.where("near").select("a", "b")
    left = judged.where("not near").select("root", "text_hash", F.lit(True).alias("far"))
    if left.isEmpty():
        return direct
    open_ = met.join(left.select("root").distinct(), "root", "left_semi").join(left, ["root", "text_hash"], "left").withColumn("far", F.coalesce("far", F.lit(False)))
    of = lambda kind: parts(F.count(F.when(kind, 1)), F.coalesce(F.sum(F.when(kind, F.col("shingles"))), F.lit(0)))
    blocks = open_.groupBy("root").agg(of(F.col("far")).alias("fars"), of(~F.col("far")).alias("nears"))
    block = F.when(F.col("far"), F.pmod("text_hash", "fars")).otherwise(F.col("fars") + F.pmod("text_hash", "nears"))
    last = F.when(F.col("far"), F.col("fars") + F.col("nears") - 1).otherwise(F.col("fars") - 1)
    placed = open_.join(blocks, "root").select("root", "text_hash", "far", block.alias("block"), last.alias("last"))
    pairs = (
        hashed.select("root", "text_hash", "fp", "wide", "hashes")
        .join(placed, ["root", "text_hash"])
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "far", "fp", "wide", "hashes")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
    )
    return direct.unionByName(pairs.mapInArrow(_judge(radius), "a long, b long"))


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, similar: bool = False) -> DataFrame:
    """One row per input row: id, text_hash, fp (long), component_id, representative.

    component_id is the smallest id in the component of the row's fingerprint, the
    row's own included; null only where every id of the component is null.
    ``representative`` is the component's first (id, text_hash), null ids last.
    ``similar`` also links texts whose distinct shingles have a Jaccard similarity of 0.8 or more.
    Null, empty and blank texts share fingerprint 0 and are linked like any other;
    repeated rows and repeated ids are grouped by their texts; an empty table gives
    no rows. Other columns are not read, so their names cannot clash.
    """
    text = F.col(text_col)
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), (F.struct(fingerprint(text, words).alias("fp")) if not similar else outlines(text, words)).alias("o"))
    own = checkpointed(read.select("id", "text_hash", "o.*"))
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    per = checkpointed(own.groupBy("fp").agg(F.min("id").alias("low"), F.min(first).alias("first"), F.count("*").alias("n")))
    pairs = links(per.select("fp"), radius)
    if similar:
        pairs = pairs.unionByName(similar_links(own, docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text")), words))
    member = connected_components(pairs).withColumnRenamed("node", "fp")
    linked = per.join(member, "fp")
    best = linked.groupBy("root").agg(F.min("low").alias("best_low"), F.min("first").alias("best_first"))
    moved = linked.join(best, "root").select("fp", "best_low", "best_first")
    label = checkpointed(
        per.join(moved, "fp", "left").select(
            "fp",
            "n",
            F.when(F.col("best_first").isNull(), F.col("low")).otherwise(F.col("best_low")).alias("component_id"),
            F.coalesce("best_first", "first").alias("representative"),
        )
    )
    total = label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first().total
    return join_skewed(own, label, "fp", "n", total).select("id", "text_hash", "fp", "component_id", "representative")


def hex_fingerprint(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, similar: bool = True) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: its smallest id (nulls last).

    All columns stay as they are, whatever their names. Rows that repeat both id and
    text count as one document. Null and empty texts are copies of each other. An empty
    table gives no rows. The texts are shuffled once, by (id, text hash), to meet the decisions.
    """
    id_name, hash_name = free_name(docs, "_near_id"), free_name(docs, "_near_hash")
    keep = (
        group_documents(docs, id_col, text_col, words, radius, similar)
        .select(F.col("representative.id").cast("string").alias("i"), F.col("representative.text_hash").alias(hash_name))
        .distinct()
        .select(F.coalesce("i", F.lit("null")).alias(id_name), hash_name)
    )
    keyed = docs.withColumns({id_name: F.coalesce(F.col(id_col).cast("string"), F.lit("null")), hash_name: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return keyed.join(keep, [id_name, hash_name], "left_semi").dropDuplicates([id_name, hash_name]).drop(id_name, hash_name)
