"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length. A product is the cosine times both lengths, so
against a bucket a query with threshold t (the k-th best product known so far)
needs cosines of at least t / (|query| * longest of the bucket). Above 1 the
bucket is skipped. A high local threshold prunes by coordinates: the larger
parts of the query leave an interval for the same coordinate of any vector at
such a cosine. A low one would prune little that way, so vectors are pruned by
their own length alone: these lie longest first, so a block of queries meets
the front that its queries need. What is left is verified with exact integer products.

The thresholds start from a fixed number of rows that every query is scored
against first, the longest and some drawn by hash: the k-th best among any rows
is a lower bound for the k-th best of all. A bucket is cut into shares of
bounded size and the queries into blocks; a block is sent to the shares that
its loosest query cannot skip. All shares are pruned by these first thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railwatch.llm.ann import _matrix, ranked
from railwatch.llm.common import bounded_batches
from railwatch.session import stored

TOP = 5
EVERY = 50
SCALE = 256
SEED_ROWS = 1024
SHARE_ROWS = 4096
BLOCK_QUERIES = 1024
# Bands of lengths per doubling; neighbouring bands with few rows make one bucket.
BANDS = 16
# From this local cosine on, coordinates are worth looking at, so many of them.
COORDINATE_COSINE = 0.6
COORDINATES = 6
# Queries that are scored together against a front.
SCORED_AT_ONCE = 128
# Lengths and cosines are rounded; pruning allows for that.
SLACK = 1e-9

_EXACT_FLOAT = 2.0**52


def _exact(queries: np.ndarray, points: np.ndarray) -> bool:
    """Whether all sums of products stay whole in floating point."""
    return bool(np.abs(queries).max() * np.abs(points).max() * queries.shape[1] < _EXACT_FLOAT)


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where all sums stay exact, else by Python integers."""
    if not queries.size or not points.size:
        return np.zeros((len(queries), len(points)))
    if _exact(queries, points):
        return queries @ points.T
    exact = queries.astype(object) @ points.astype(object).T
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, int(x))), otypes=[object])(exact)


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole numbers and length of the vectors without null or non-finite components."""
    for batch in batches:
        vectors = batch.column("v")
        sizes = np.diff(vectors.offsets.to_numpy())
        x = vectors.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
        row = np.repeat(np.arange(len(sizes)), sizes)
        fine = np.bincount(row[~np.isfinite(x)], minlength=len(sizes)) == 0
        x, row, sizes = x[fine[row]], row[fine[row]], sizes[fine]
        row = np.repeat(np.arange(len(sizes)), sizes)
        # From 2**52 on a double is whole already. Adding 0 turns -0 into 0.
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.where(np.abs(x) < 2.0**52, np.floor(x * SCALE) + 0.0, x * SCALE)
            # Scaled by the largest part, so squares do not overflow.
            top = np.zeros(len(sizes))
            filled = sizes > 0
            if filled.any():
                top[filled] = np.maximum.reduceat(np.abs(whole), (np.cumsum(sizes) - sizes)[filled])
            parts = whole / np.where(top > 0, top, 1.0)[row]
            length = top * np.sqrt(np.bincount(row, parts * parts, minlength=len(sizes)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        ids = batch.column("vec_id").filter(pa.array(fine))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(whole)), pa.array(length)], ["vec_id", "v", "length"])


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers as doubles) and length of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = bounded_batches(rows.filter("vec_id is not null and v is not null"))
    return rows.mapInArrow(_wholes, "vec_id long, v array<double>, length double")


def _band() -> Column:
    return F.when(F.col("length") > 0, F.floor(F.log2("length") * BANDS).cast("int")).otherwise(F.lit(-(2**20)))


def _buckets(bands: list) -> list[tuple[int, int, float, float, int]]:
    """(first band, last band, least length, largest length, shares) from counts per band."""
    out, open_, rows = [], [], 0
    for band in sorted(bands, key=lambda b: b.band):
        open_.append(band)
        rows += band.n
        if rows >= SHARE_ROWS:
            out.append((open_, rows))
            open_, rows = [], 0
    if open_:
        out.append((open_, rows))
    return [(g[0].band, g[-1].band, min(b.least for b in g), max(b.most for b in g), -(-n // SHARE_ROWS)) for g, n in out]


def _started(shared, top: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A threshold for every query and the buckets that it cannot skip."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width, seed_ids, seeds, buckets = shared.value
        for frame in frames:
            if not len(frame):
                continue
            points = _matrix(list(frame["v"]), width)
            scores = products(points, seeds).astype(float)
            scores[seed_ids == frame["query_id"].to_numpy()[:, None]] = -np.inf
            kth = -np.partition(-scores, top - 1, axis=1)[:, top - 1] if scores.shape[1] >= top else np.full(len(points), -np.inf)
            reach = frame["length"].to_numpy()[:, None] * np.array([b[3] for b in buckets])
            needed = (kth[:, None] <= 0) | (reach * (1 + SLACK) >= kth[:, None])
            rows = [
                (q, v, length, t, number, share)
                for q, v, length, t, need in zip(frame["query_id"], frame["v"], frame["length"], kth, needed)
                for number in np.flatnonzero(need)
                for share in range(buckets[number][4])
            ]
            yield pd.DataFrame(rows, columns=["query_id", "v", "length", "threshold", "bucket", "share"])

    return run


def candidates(query: np.ndarray, length: float, threshold: float, points: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Places of the vectors of a bucket that may reach ``threshold``."""
    if threshold <= 0 or not length or not len(lengths):
        return np.arange(len(points))
    cosine = threshold / (length * lengths.max()) if lengths.max() else np.inf
    if cosine > 1 + SLACK:
        return np.empty(0, np.int64)
    keep = lengths * length * (1 + SLACK) >= threshold
    if cosine >= COORDINATE_COSINE:
        unit = query / length
        for axis in np.argsort(-np.abs(unit), kind="stable")[:COORDINATES]:
            part = unit[axis]
            spread = np.sqrt(max(0.0, 1 - cosine**2) * max(0.0, 1 - part**2)) + SLACK
            # Any vector at this cosine or more lies in the cap around the query; the cap's own top ends at 1 or -1.
            low = -1.0 if -part >= cosine else part * cosine - spread
            high = 1.0 if part >= cosine else part * cosine + spread
            keep &= (units[:, axis] >= low) & (units[:, axis] <= high)
    return np.flatnonzero(keep)


def _best(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, thresholds: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """The ``top`` best of each row of ``scores`` that reach its threshold, ties by id; a query's own id is left out."""
    scores[asked[:, None] == ids] = -np.inf
    enough = (scores >= thresholds[:, None]) & (scores > -np.inf)
    for i in np.flatnonzero(enough.sum(axis=1) > top):
        enough[i] &= scores[i] >= -np.partition(-scores[i], top - 1)[top - 1]
    at, place = np.nonzero(enough)
    found = scores[at, place]
    order = np.lexsort((ids[place], -found, at))
    at, place, found = at[order], place[order], found[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < top
    return list(zip(asked[at[first]].tolist(), ids[place[first]].tolist(), found[first].astype(np.int64).tolist()))


def _verified(shared, top: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        width, rows = shared.value[0], []
        if len(entries) and len(queries):
            entries = entries.sort_values(["length", "vec_id"], ascending=[False, True], kind="stable")
            ids, lengths = entries["vec_id"].to_numpy(), entries["length"].to_numpy()
            points = _matrix(list(entries["v"]), width)
            asked, reach, thresholds = (queries[c].to_numpy() for c in ("query_id", "length", "threshold"))
            wanted = _matrix(list(queries["v"]), width)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where((thresholds > 0) & (reach > 0), thresholds / reach, 0.0)
                steep = least >= COORDINATE_COSINE * lengths[0]
            if wanted.size and not _exact(wanted, points):
                steep[:] = True
            # Vectors lie longest first: of each query the front that is long enough, queries with like fronts together.
            fronts = np.searchsorted(-lengths, -least / (1 + SLACK), side="right")
            level = np.flatnonzero(~steep)
            level = level[np.argsort(fronts[level], kind="stable")]
            for start in range(0, len(level), SCORED_AT_ONCE):
                part = level[start : start + SCORED_AT_ONCE]
                front = fronts[part].max()
                if front:
                    rows += _best(asked[part], ids[:front], products(wanted[part], points[:front]), thresholds[part], top)
            units = points / np.where(lengths > 0, lengths, 1.0)[:, None] if steep.any() else points
            for i in np.flatnonzero(steep):
                at = candidates(wanted[i], reach[i], thresholds[i], points, lengths, units)
                at = at[ids[at] != asked[i]]
                at = at[np.argsort(ids[at], kind="stable")]
                scores = products(wanted[i][None], points[at])[0]
                best = sorted(range(len(at)), key=lambda j: -scores[j])[:top]
                rows += [(asked[i], int(ids[at[j]]), int(scores[j])) for j in best if scores[j] >= thresholds[i]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_products(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` largest integer products of every query.

    Components are floor(256 * x). Queries are the rows whose vec_id is
    divisible by ``every``, candidates all rows but those with the query's own
    id. Ties go to the smaller vec_id. Null vectors, vectors with null or
    non-finite components and rows without an id take no part; missing
    components count as 0, and zero vectors take part. Products beyond a long are
    cut to its range. Rows that share an id are candidates each, and their least
    vector is the query. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors).withColumn("band", _band()), "quantised")
    bands = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("length").alias("least"),
        F.max("length").alias("most"),
        F.max(F.size("v")).alias("width"),
    )
    found = bands.collect()  # bands cover the range of a double: at most 16 * 2,100 rows
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    buckets, width = _buckets(found), max(r.width for r in found)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).collect()
    longest = rows.orderBy(F.desc("length"), "vec_id").limit(SEED_ROWS).collect()
    seeds = list({(r.vec_id, tuple(r.v)): r for r in [*drawn, *longest]}.values())
    shared = spark.sparkContext.broadcast(
        (width, np.array([r.vec_id for r in seeds]), _matrix([r.v for r in seeds], width), buckets)
    )
    bucket = F.array(*(F.lit(b[1]) for b in buckets))
    placed = rows.withColumn("bucket", F.size(F.filter(bucket, lambda last: last < F.col("band"))))
    shares = F.element_at(F.array(*(F.lit(b[4]) for b in buckets)), F.col("bucket") + 1)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "length")).alias("least"))
    asked = asked.select("query_id", "least.v", "least.length")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    dealt = placed.select("vec_id", "v", "length", "bucket", F.pmod(F.xxhash64("vec_id"), shares).cast("int").alias("share"), every_block)
    queries = asked.mapInPandas(
        _started(shared, top), "query_id long, v array<double>, length double, threshold double, bucket int, share int"
    ).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    keys = ["bucket", "share", "block"]
    scored = dealt.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_verified(shared, top), "query_id long, vec_id long, score long")
    return ranked(scored, top).select("query_id", "rank", "vec_id", "score")
