"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves and each half is quantised by a codebook of its
own, so a vector falls into the cell of a pair of centroids. A query visits
pairs in the order of the sum of its halves' distances to the two centroids,
taken from a heap that grows along the two sorted lists, until the visited
cells hold enough entries; those are then ranked by the exact inner product.

Inner products are turned into distances by one more component: entries are
lengthened to the longest vector's norm with it, queries have 0 there, so near
means a large product whatever the lengths.

Entries are stored by their first centroid: centroids with few entries together
in one region, and a region with many in shares of bounded size, so a centroid
with most of the entries is searched by many tasks. A query is sent to the
shares of the regions it visits, with the cells it visits there. Queries are
dealt into blocks of bounded size as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.session import stored

NEAREST = 20
EVERY = 20
CENTROIDS = 64
SAMPLE_ROWS = 8192
ROUNDS = 12
# Entries to rerank: this part of all, and this many at least.
VISIT = 0.5
VISIT_LEAST = 2000
SHARE_ROWS = 16384
BLOCK_QUERIES = 8192
# Cells are traversed by so many queries in a task.
ROUTED_QUERIES = 128
SEED = 5


def usable(vectors: DataFrame, zeros: bool) -> DataFrame:
    """vec_id, v: vectors without null or non-finite components; zero vectors only on demand."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # abs(x) < infinity is false for infinities, and NaN counts as larger than them.
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    return rows if zeros else rows.filter(F.exists(v, lambda x: x != 0))


def _kmeans(points: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random points; empty clusters keep their centroid."""
    distinct = np.unique(points, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:count]]
    for _ in range(ROUNDS):
        nearest = _square_distances(points, centroids).argmin(axis=1)
        for i in range(len(centroids)):
            members = points[nearest == i]
            if len(members):
                centroids[i] = members.mean(axis=0)
    return centroids


def _square_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; missing components count as 0."""
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, float) for v in vectors]).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Index:
    """Two codebooks over halves of lengthened vectors, scaled to a longest norm of 1."""

    def __init__(self, sample: np.ndarray, longest: float, count: int) -> None:
        self.width, self.longest, self.cut = sample.shape[1], longest, (sample.shape[1] + 1) // 2
        rng = np.random.default_rng(SEED)
        first, second = self.halves(sample, entries=True)
        self.first, self.second = _kmeans(first, count, rng), _kmeans(second, count, rng)

    def halves(self, points: np.ndarray, entries: bool) -> tuple[np.ndarray, np.ndarray]:
        points = points / self.longest
        extra = np.sqrt(np.maximum(0.0, 1.0 - (points**2).sum(axis=1))) if entries else np.zeros(len(points))
        return points[:, : self.cut], np.column_stack([points[:, self.cut :], extra])

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.halves(points, entries=True)
        return _square_distances(first, self.first).argmin(axis=1), _square_distances(second, self.second).argmin(axis=1)

    def visited(self, points: np.ndarray, filled: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query the visited cells as a boolean matrix; ``filled`` counts the entries of a cell."""
        length = np.maximum(np.sqrt((points**2).sum(axis=1, keepdims=True)), 1e-300)
        first, second = self.halves(points / length * self.longest, entries=False)
        both = _square_distances(first, self.first), _square_distances(second, self.second)
        for a, b in zip(*both):
            yield self._traversed(a, b, filled, wanted)

    @staticmethod
    def _traversed(a: np.ndarray, b: np.ndarray, filled: np.ndarray, wanted: int) -> np.ndarray:
        by_a, by_b, seen, gathered = a.argsort(kind="stable"), b.argsort(kind="stable"), np.zeros(filled.shape, bool), 0
        heap = [(a[by_a[0]] + b[by_b[0]], 0, 0)]
        while heap and gathered < wanted:
            _, i, j = heapq.heappop(heap)
            seen[by_a[i], by_b[j]] = True
            gathered += filled[by_a[i], by_b[j]]
            if j + 1 < len(by_b):
                heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(by_a):
                heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[0]], i + 1, 0))
        return seen


def fit(rows: DataFrame, count: int = CENTROIDS) -> Index | None:
    """Codebooks from the ``SAMPLE_ROWS`` rows whose id hashes lowest; None without rows."""
    bounds = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    if bounds.width is None:
        return None
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    return Index(_matrix([r.v for r in sample], bounds.width), float(np.sqrt(bounds.square)), count)


def _assigned(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for frame in frames:
            if len(frame):
                first, second = index.cells(_matrix(list(frame["v"]), index.width))
                yield frame.assign(first=first.astype("int32"), second=second.astype("int32"))

    return run


def _regions(entries: np.ndarray) -> list[np.ndarray]:
    """First centroids in runs that hold ``SHARE_ROWS`` entries or are one centroid with more."""
    out, open_, rows = [], [], 0
    for first, count in enumerate(entries):
        open_.append(first)
        rows += count
        if rows >= SHARE_ROWS or first == len(entries) - 1:
            out.append(np.array(open_))
            open_, rows = [], 0
    return out


def _routed(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A row for each share of each region that a query visits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, filled, regions, shares, wanted = shared.value
        for frame in frames:
            if not len(frame):
                continue
            rows = []
            visits = index.visited(_matrix(list(frame["v"]), index.width), filled, wanted)
            for vec_id, v, seen in zip(frame["vec_id"], frame["v"], visits):
                for region, firsts in enumerate(regions):
                    if seen[firsts].any():
                        cells = np.packbits(seen[firsts].ravel()).tobytes()
                        rows += [(vec_id, v, cells, region, share) for share in range(shares[region])]
            yield pd.DataFrame(rows, columns=["query_id", "v", "cells", "region", "share"])

    return run


def _reranked(shared, nearest: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index = shared.value
        columns = ["query_id", "vec_id", "score"]
        if not len(entries) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        entries = entries.sort_values("vec_id", kind="stable")
        ids, cell = entries["vec_id"].to_numpy(), entries["cell"].to_numpy()
        points = _matrix(list(entries["v"]), index.width)
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            seen = np.array([np.unpackbits(np.frombuffer(c, np.uint8)) for c in part["cells"]], bool)
            asked, wanted = part["query_id"].to_numpy(), _matrix(list(part["v"]), index.width)
            # Rounded, so that equal vectors tie however the product was blocked; the few kept are scored anew.
            scale = np.sqrt((wanted**2).sum(axis=1, keepdims=True)) * index.longest
            scores = np.round(wanted @ points.T / scale, 12)
            scores[~seen[:, cell] | (ids == asked[:, None])] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :nearest]
            keep = np.isfinite(np.take_along_axis(scores, order, axis=1))
            found = (wanted[:, None, :] * points[order]).sum(axis=2)
            out.append(
                pd.DataFrame(
                    {"query_id": np.repeat(asked, keep.sum(axis=1)), "vec_id": ids[order[keep]], "score": found[keep]},
                    columns=columns,
                )
            )
        return pd.concat(out)

    return run


def nearest_neighbours(
    vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY, visit: float = VISIT
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest entries found for every query.

    Queries are the rows whose vec_id is divisible by ``every``; a query is
    never its own neighbour. Entries that are visited are scored exactly, in
    double precision, and ties go to the smaller vec_id. Null, zero and
    non-finite vectors and rows without an id take no part; missing components
    count as 0. Rows that share an id are entries each, and their least vector is
    the query.
    The codebooks are fitted on ``SAMPLE_ROWS`` rows; every row is indexed.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, zeros=False)
    index = fit(rows)
    result = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], result)
    shared = spark.sparkContext.broadcast(index)
    entries = stored(rows.mapInPandas(_assigned(shared), "vec_id long, v array<double>, first int, second int"), "entries")
    filled = np.zeros((len(index.first), len(index.second)), np.int64)
    for row in entries.groupBy("first", "second").count().collect():  # one row per cell, at most CENTROIDS squared
        filled[row["first"], row["second"]] = row["count"]
    regions = _regions(filled.sum(axis=1))
    shares = [int(max(1, -(-filled[firsts].sum() // SHARE_ROWS))) for firsts in regions]
    wanted = max(VISIT_LEAST, int(np.ceil(visit * filled.sum())))
    plan = spark.sparkContext.broadcast((index, filled, regions, shares, wanted))

    def of_first(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("first") + 1)

    region = of_first([r for r, firsts in enumerate(regions) for _ in firsts])
    # Cells are numbered within their region.
    cell = of_first([i for firsts in regions for i in range(len(firsts))]) * len(index.second) + F.col("second")
    share = F.pmod(F.xxhash64("vec_id"), of_first([shares[r] for r, firsts in enumerate(regions) for _ in firsts]))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked, "asked")
    count = asked.count()
    blocks = max(1, -(-count // BLOCK_QUERIES))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    dealt = entries.select("vec_id", "v", cell.alias("cell"), region.alias("region"), share.cast("int").alias("share"), every_block)
    queries = asked.repartition(max(1, -(-count // ROUTED_QUERIES)), "vec_id").mapInPandas(
        _routed(plan), "query_id long, v array<double>, cells binary, region int, share int"
    ).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    keys = ["region", "share", "block"]
    found = (
        dealt.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInPandas(_reranked(shared, nearest), "query_id long, vec_id long, score double")
    )
    return ranked(found, nearest).select("query_id", "rank", "vec_id", "score")


def ranked(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
