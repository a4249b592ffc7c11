"""Stories: clusters of articles by embedding, and what is shown of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.operators import similar


def rollup(articles: DataFrame) -> DataFrame:
    """articles(story, id, slug, title, content, qa_score, published_at) per story: counts, range and the representative.

    The representative has the highest score (none counts 0), then the longest content,
    then the earliest date (none last), then the smallest id. A combining aggregate.
    """
    epoch = F.coalesce(-F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(-(1 << 62)))
    worth = F.struct(F.coalesce("qa_score", F.lit(0)), F.length(F.coalesce("content", F.lit(""))), epoch, -F.col("id"))
    return articles.groupBy("story").agg(
        F.count("*").alias("article_count"),
        F.count_distinct("slug").alias("source_count"),
        F.min("published_at").alias("first_published"),
        F.max("published_at").alias("last_published"),
        F.max_by("id", worth).alias("best_id"),
        F.max_by("title", worth).alias("title"),
    )


#: Vectors that are screened at once, centroids in one slab, and near centroids that a vector keeps beside the nearest.
CHUNK, SLAB, KEPT = 512, 4096, 64
#: Dot products of single precision are off by less than so much, for vectors of unit length.
SLACK = 1e-4


class Fold:
    """The greedy fold: each vector joins the nearest centroid at ``threshold`` or more, the first of equals, else opens one.

    Vectors are screened CHUNK by CHUNK against slabs of centroids in single precision, one matrix
    product each; what may be the nearest is compared exactly. Centroids that moved since their
    screening are screened again. Exact centroids are held without their zeros where these are many.
    """

    def __init__(self, threshold: float):
        self.threshold, self.sizes, self.exact, self.slabs, self.longest = threshold, [], [], [], 1.0

    def add(self, v: np.ndarray) -> int:
        return self.add_all(v[None, :])[0]

    def add_all(self, vectors: np.ndarray) -> list[int]:
        """The cluster of each row, one after the other."""
        vectors = np.asarray(vectors, float)
        return [k for at in range(0, len(vectors), CHUNK) for k in self._chunk(vectors[at : at + CHUNK])]

    def centroid(self, k: int) -> np.ndarray:
        width, at, values = self.exact[k]
        c = np.zeros(width)
        c[at] = values
        return c

    def _put(self, k: int, c: np.ndarray) -> None:
        at = np.flatnonzero(c)
        kept = (len(c), at.astype(np.int32), c[at]) if 2 * len(at) < len(c) else (len(c), slice(None), c.copy())
        if k == len(self.exact):
            self.exact.append(kept)
            if k == len(self.slabs) * SLAB:
                self.slabs.append(np.zeros((SLAB, len(c)), np.float32))
        else:
            self.exact[k] = kept
        self.slabs[k // SLAB][k % SLAB] = c

    def _screened(self, quick: np.ndarray, least: np.ndarray, slack: np.ndarray):
        """(first candidate of each row, candidates' clusters, their products, rows of which only those near the best are kept)."""
        rows, found, dots = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        best, partial = np.full(len(quick), -np.inf, np.float32), np.zeros(len(quick), bool)
        for s, slab in enumerate(self.slabs):
            all_dots = quick @ slab[: len(self.sizes) - s * SLAB].T
            r, c = np.nonzero(~(all_dots < least[:, None]))  # what is no number is a candidate, too
            if len(r):
                d = np.nan_to_num(all_dots[r, c], nan=np.inf)
                np.maximum.at(best, r, d)
                rows, found, dots = np.concatenate([rows, r]), np.concatenate([found, c + s * SLAB]), np.concatenate([dots, d])
                partial |= np.bincount(rows, minlength=len(quick)) > KEPT
                if partial.any():
                    keep = ~partial[rows] | (dots >= best[rows] - 2 * slack[rows])
                    rows, found, dots = rows[keep], found[keep], dots[keep]
        order = np.argsort(rows, kind="stable")
        return np.searchsorted(rows[order], np.arange(len(quick) + 1)), found[order], dots[order], partial

    def _chunk(self, vectors: np.ndarray) -> list[int]:
        quick, lengths = vectors.astype(np.float32), np.linalg.norm(vectors, axis=1)
        self.longest = max(self.longest, float(lengths.max(initial=1.0)))
        slack = SLACK * np.maximum(lengths, 1.0) * self.longest
        least = max(self.threshold, 0.0) - slack
        first, found, dots, partial = self._screened(quick, least, slack)
        within = quick @ quick.T
        inner_row, inner = np.nonzero(np.tril(~(within < least[:, None]), -1))
        inner_first = np.searchsorted(inner_row, np.arange(len(quick) + 1))
        opened, moved, again, out = {}, {}, np.zeros_like(quick), []
        for i, v in enumerate(vectors):
            near = [(k, d) for k, d in zip(found[first[i] : first[i + 1]].tolist(), dots[first[i] : first[i + 1]].tolist(), strict=True)]
            if partial[i] and any(k in moved for k, _ in near):
                _, k, d, _ = self._screened(quick[i : i + 1], least[i : i + 1], slack[i : i + 1])  # with all that is there now
                near = list(zip(k.tolist(), d.tolist(), strict=True))
            else:
                near = [x for x in near if x[0] not in moved]
                near += [(opened[j], within[i, j]) for j in inner[inner_first[i] : inner_first[i + 1]].tolist() if j in opened and opened[j] not in moved]
                if moved:
                    near += zip(moved, (again[: len(moved)] @ quick[i]).tolist(), strict=True)
            pick, sim = -1, -np.inf
            if near:
                enough = max(least[i], max(np.inf if d != d else d for _, d in near) - 2 * slack[i])
                for k in sorted({k for k, d in near if not d < enough}):
                    if (dot := float((self.centroid(k) * v).sum())) > sim:
                        pick, sim = k, dot
            if sim >= self.threshold and sim > 0:
                self.sizes[pick] += 1
                c = (self.centroid(pick) * (self.sizes[pick] - 1) + v) / self.sizes[pick]
                self._put(pick, c / (np.linalg.norm(c) or 1.0))
                again[moved.setdefault(pick, len(moved))] = self.slabs[pick // SLAB][pick % SLAB]
            else:
                pick = opened[i] = len(self.sizes)
                self._put(pick, v)
                self.sizes.append(1)
            out.append(pick)
        return out


def greedy(vectors: np.ndarray, threshold: float) -> list[int]:
    """Cluster numbers of vectors in the given order by one ``Fold``."""
    return Fold(threshold).add_all(vectors)


def clusters(vectors: DataFrame, threshold: float, block: str, order: list[str], id_col: str, vector: str) -> DataFrame:
    """(id_col, block, cluster): greedy clusters within each block of ``vectors``, folded in the ``order`` of columns.

    Vectors of different blocks never share a cluster. The fold depends on the order, so
    a block is one task's, which streams it and holds its centroids only; choose blocks
    of bounded size, such as ``windows``. One block of all rows is the plain fold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for pdf in batches:
            found, blocks = [], pdf[block].to_numpy()
            ends = [*(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(pdf)] if len(pdf) else []
            for begin, end in zip([0, *ends], ends, strict=False):
                if fold is None or blocks[begin] != now:
                    now, fold = blocks[begin], Fold(threshold)
                found += fold.add_all(np.array(pdf[vector].iloc[begin:end].tolist(), float))
            yield pd.DataFrame({id_col: pdf[id_col], block: pdf[block], "cluster": np.array(found, dtype=np.int64)})

    kinds = dict(vectors.dtypes)
    dealt = vectors.select(*dict.fromkeys([*order, id_col, block, vector])).repartition(block).sortWithinPartitions(block, *order)
    return dealt.mapInPandas(run, f"{id_col} {kinds[id_col]}, {block} {kinds[block]}, cluster long")


def exact_clusters(vectors: DataFrame, threshold: float, order: list[Column], id_col: str, vector: str) -> DataFrame:
    """(id_col, cluster): greedy clusters of all ``vectors`` in one total ``order``.

    Every decision depends on the centroids that all earlier ones moved, so one task
    streams all rows in order; it holds the centroids and a batch, and takes O(n k).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Fold(threshold)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "cluster": np.array(fold.add_all(np.array(pdf[vector].tolist(), float)), dtype=np.int64)})

    # the fold is sequential
    return vectors.repartition(1).sortWithinPartitions(*order).select(id_col, vector).mapInPandas(run, f"{id_col} {dict(vectors.dtypes)[id_col]}, cluster long")


def windows(vectors: DataFrame, at: str, hours: int = 48) -> DataFrame:
    """``vectors`` with ``block``, the number of the ``hours`` window that ``at`` is in; -1 without a time.

    A block of greedy clusters so holds what arrives in one window, however long the history is.
    """
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    return vectors.withColumn("block", F.coalesce(F.floor(seconds / (hours * 3600)), F.lit(-1)).cast("long"))


def matched(clusters: DataFrame, stories: DataFrame, threshold: float) -> DataFrame:
    """(block, cluster, story, is_new): the story that each of a run's clusters joins or opens.

    clusters(block, cluster, vector) are the runs' clusters in the order of their
    numbers, stories(story, rank, vector) what exists, in the order of ``rank``; vectors have unit
    length. A cluster takes the most similar story at ``threshold`` or more, the first of
    equals; what earlier clusters of its run opened comes after what exists. The stories are
    searched on Spark; what depends on the order, the new stories of one run, is folded run by run.
    """
    key = F.concat_ws("/", "block", "cluster")
    near = similar.best_of(clusters.select(key.alias("id"), "vector"), stories.select(F.col("story").alias("id"), "rank", "vector"), "id", "vector", rank="rank", itself=True)
    known = clusters.withColumn("query_id", key).join(near, "query_id", "left").select("block", "cluster", "vector", F.col("id").alias("story"), "cosine")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, new = None, []
        for pdf in batches:
            rows = []
            for b, c, v, story, sim in pdf.itertuples(index=False):
                if b != now:
                    now, new = b, []
                v = np.asarray(v, float)
                best, best_sim = (story, sim) if story is not None and sim > 0 else (None, 0.0)
                for name, w in new:
                    if (s := round(float(w @ v), 6)) > best_sim:
                        best, best_sim = name, s
                if best is None or best_sim < threshold:
                    best = f"new-{b}-{c}"
                    new.append((best, v))
                rows.append((b, c, best, best.startswith("new-")))
            yield pd.DataFrame(rows, columns=["block", "cluster", "story", "is_new"])

    dealt = known.repartition("block").sortWithinPartitions("block", "cluster")
    return dealt.mapInPandas(fold, "block long, cluster long, story string, is_new boolean")


def refreshed(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """``stories`` with article_count, source_count, first_published and last_published recomputed from articles(story, slug, published_at); a story without articles counts none and keeps its times."""
    now = articles.groupBy("story").agg(F.count("*").alias("_n"), F.count_distinct("slug").alias("_s"), F.min("published_at").alias("_f"), F.max("published_at").alias("_l"))
    fresh = {"article_count": F.coalesce("_n", F.lit(0)), "source_count": F.coalesce("_s", F.lit(0)), "first_published": F.coalesce("_f", "first_published"), "last_published": F.coalesce("_l", "last_published")}
    return stories.join(now, "story", "left").withColumns(fresh).select(*stories.columns)


def with_sources(stories: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``stories`` with ``sources``, the array of (name, slug) of their articles, by name; empty without any."""
    named = articles.select("story", "slug").distinct().join(F.broadcast(sources.select("slug", "name")), "slug")  # one row a source
    lists = named.groupBy("story").agg(F.array_sort(F.collect_set(F.struct("name", "slug"))).alias("sources"))
    empty = F.array().cast("array<struct<name:string,slug:string>>")
    return stories.join(lists, "story", "left").withColumn("sources", F.coalesce("sources", empty))
