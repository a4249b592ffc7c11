"""The best vector for each query by dot product, exactly, without comparing it with all.

Vectors are assigned to the pivot at the smallest angle. Angles obey the triangle
inequality, so a query's angle to a pivot and the range of its members' angles bound
every dot product with a member. A query visits its most promising pivot first, and
then only the pivots whose bound is no worse than what it found. Both sides of a
visit are cut into blocks, so no task holds more than two blocks, however many vectors a
pivot has or queries visit it.

The pivots come from a bounded sample; they affect the cost only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import checkpointed

#: Vectors that pivots are chosen from, those of the smallest seeded hash, and the most pivots.
SAMPLE, MOST_PIVOTS = 8192, 1024
#: Vectors, and queries, in one block.
VECTORS, QUERIES = 8192, 2048
#: Dot products are rounded to so many digits; bounds are taken as much larger, with an allowance for angles.
DIGITS, SLACK = 6, 2e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of doubles."""
    rows = column.to_pylist()
    return np.array(rows, dtype=float).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def angles(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle of every row with every unit pivot, length of every row); a row of length 0 has right angles."""
    length = np.linalg.norm(rows, axis=1)
    return np.arccos(np.clip(rows @ pivots.T / np.where(length > 0, length, 1.0)[:, None], -1.0, 1.0)), length


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit rows of a sample far from each other: each next one has the largest angle to those chosen."""
    length = np.linalg.norm(sample, axis=1)
    rows = sample[length > 0] / length[length > 0][:, None]
    if not len(rows):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    picked, near = [0], rows @ rows[0]
    while len(picked) < min(n, len(rows)) and near.min() < 1 - 1e-9:
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[picked[-1]])
    return rows[picked]


def _assign(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (i, r, v) with the pivot of the smallest angle, that angle, and their length."""
    for batch in batches:
        angle, length = angles(matrix(batch.column(2)), pivots)
        pivot = np.argmin(angle, axis=1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(angle[np.arange(len(pivot)), pivot]), pa.array(length)], names=["i", "r", "v", "pivot", "angle", "length"]
        )


def bounds(angle: np.ndarray, length: np.ndarray, members: np.ndarray) -> np.ndarray:
    """[query, pivot]: no dot product with a member is larger. members[:, pivot]: least and largest angle and length."""
    low, high, short, long = members
    apart = np.maximum(np.maximum(angle - high, low - angle), 0.0) - SLACK
    cosine = np.cos(np.clip(apart, 0.0, np.pi))
    return length[:, None] * np.where(cosine > 0, long, short) * cosine + SLACK


def _visits(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, members: np.ndarray, first: bool) -> Iterator[pa.RecordBatch]:
    """(q, v, pivot): the pivot of the largest bound of each query (q, v), or all others whose bound is no less than ``best``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bound = bounds(*angles(matrix(batch.column(1)), pivots), members)
        home = np.argmax(bound, axis=1)
        if first:
            rows, pivot = np.arange(len(home)), home
        else:
            best = np.array([-np.inf if b is None else b for b in batch.column(2).to_pylist()])
            bound[np.arange(len(home)), home] = -np.inf
            rows, pivot = np.nonzero((bound >= best[:, None]) & np.isfinite(bound))
        taken = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(pivot.astype(np.int32))], names=["q", "v", "pivot"])


def _meet(queries: pa.Table, vectors: pa.Table, itself: bool) -> pa.Table:
    """(query_id, id, r, cosine): the best of one block of vectors for each query of another."""
    names = ["query_id", "id", "r", "cosine"]
    kinds = [queries.schema.field("q").type, vectors.schema.field("i").type, vectors.schema.field("r").type, pa.float64()]
    if not queries.num_rows or not vectors.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    vectors = vectors.sort_by("r")
    dots = np.round(matrix(queries.column("v")) @ matrix(vectors.column("v")).T, DIGITS)
    if not itself:
        own = {x: k for k, x in enumerate(queries.column("q").to_pylist())}
        for k, x in enumerate(vectors.column("i").to_pylist()):
            if x in own:
                dots[own[x], k] = -np.inf
    pick = np.argmax(dots, axis=1)
    value = dots[np.arange(len(pick)), pick]
    good = np.flatnonzero(np.isfinite(value))
    at = pa.array(pick[good])
    columns = [queries.column("q").take(pa.array(good)), vectors.column("i").take(at), vectors.column("r").take(at), pa.array(value[good])]
    return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)


def best_of(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, rank: str | None = None, itself: bool = False, pivots: int | None = None, report: dict | None = None) -> DataFrame:
    """(query_id, id, cosine): for each query the vector with the largest dot product, rounded, ties to the smallest ``rank`` (default: id).

    A query meets no row of its own id unless ``itself``. One row a query id. Rows
    with a null vector are left out; a query that meets nothing gives no row. ``pivots``:
    how many (default: the square root of the rows, MOST_PIVOTS at most). ``report`` is given
    ``visited`` and ``pairs``, the visits made and those there would be without bounds.
    """
    rank = rank or id_col
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(rank).alias("r"), F.col(vector).cast("array<double>").alias("v"))
    asked = checkpointed(queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("q"), F.col(vector).cast("array<double>").alias("v")))
    total = rows.count()
    wanted = pivots or max(1, min(MOST_PIVOTS, int(total**0.5)))
    sample = rows.select("v", F.xxhash64(F.lit(42), "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    chosen = choose(matrix(sample.column("v")), wanted)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"q": asked.schema["q"].dataType.simpleString()}
    found = f"query_id {kinds['q']}, id {kinds['i']}, r {kinds['r']}, cosine double"
    if not total:
        return vectors.sparkSession.createDataFrame([], f"query_id {kinds['q']}, id {kinds['i']}, cosine double")
    if not len(chosen):  # vectors of no length have no angles; any pivot does
        chosen = np.eye(1, len(sample.column("v")[0]))
    held = checkpointed(rows.mapInArrow(partial(_assign, pivots=chosen), f"i {kinds['i']}, r {kinds['r']}, v array<double>, pivot int, angle double, length double"))
    # a row a pivot
    known = held.groupBy("pivot").agg(F.count("*").alias("n"), F.min("angle"), F.max("angle"), F.min("length"), F.max("length")).collect()
    members, sizes = np.full((4, len(chosen)), np.nan), {}
    for r in known:
        sizes[r.pivot] = r.n
        members[:, r.pivot] = r[2:]
    # pivots without members are never visited
    live = np.array(sorted(sizes), dtype=int)
    numbers = dict(enumerate(live.tolist()))
    blocks = [-(-sizes[numbers[k]] // VECTORS) for k in range(len(live))]
    visit = partial(_visits, pivots=chosen[live], members=members[:, live])
    shape = f"q {kinds['q']}, v array<double>, pivot int"
    spark = vectors.sparkSession
    places = spark.createDataFrame([(k, numbers[k], blocks[k]) for k in range(len(live))], "pivot int, real int, n_blocks int")

    def met(asking: DataFrame) -> DataFrame:
        """What the visits of ``asking(q, v, pivot)`` find: blocks of vectors against blocks of queries."""
        asking = checkpointed(asking)
        counted = asking.groupBy("pivot").agg(F.count("*").alias("visits")).join(F.broadcast(places), "pivot")  # at most MOST_PIVOTS rows
        counted = checkpointed(counted.withColumn("n_chunks", F.expr(f"(visits + {QUERIES - 1}) div {QUERIES}").cast("int")))
        if report is not None:
            report["visited"] = report.get("visited", 0) + (counted.agg(F.sum("visits")).first()[0] or 0)
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        small = F.broadcast(counted.select("pivot", "real", "n_blocks", "n_chunks"))
        left = asking.join(small, "pivot").select("real", F.pmod(F.xxhash64("q"), F.col("n_chunks")).cast("int").alias("chunk"), upto("n_blocks").alias("block"), "q", "v")
        cut = F.pmod(F.xxhash64("i"), F.col("n_blocks")).cast("int").alias("block")
        right = held.withColumnRenamed("pivot", "real").join(small, "real").select("real", upto("n_chunks").alias("chunk"), cut, "i", "r", "v")
        keys = ["real", "chunk", "block"]
        each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(partial(_meet, itself=itself), found)
        return each.groupBy("query_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "r", "id")).alias("m"))

    first = checkpointed(met(asked.mapInArrow(partial(visit, first=True), shape)))
    better = asked.join(first.select(F.col("query_id").alias("q"), (-F.col("m.c")).alias("best")), "q", "left")
    second = checkpointed(met(better.mapInArrow(partial(visit, first=False), shape)))
    if report is not None:
        report["pairs"] = asked.count() * len(live)
    both = first.unionByName(second).groupBy("query_id").agg(F.min("m").alias("m"))
    return both.select("query_id", F.col("m.id").alias("id"), (-F.col("m.c")).alias("cosine"))


def nearest(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, **options) -> DataFrame:
    """(query_id, id, cosine): for each query the nearest other vector, ties to the smallest id."""
    return best_of(queries, vectors, id_col, vector, **options)
