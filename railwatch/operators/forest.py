"""Isolation forest per tenant and segment.

Trees are grown on samples of at most 256 rows, chosen by hashing the row's id
per tree, so no row order or partitioning changes a model. Each row is scored
against its own segment's trees in bounded chunks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.functions.chunks import map_chunks
from railwatch.functions.joins import join_small
from railwatch.functions.scalars import observation_tier
from railwatch.operators.vectors import SEGMENT, forest_vectors, training_rows
from railwatch.session import stored

TREES = 100
SAMPLE_ROWS = 256
SEED = 42

_TREE = "tenant_bank_id string, segment string, tree int, sample_rows int, feature array<int>, cut array<double>, below array<int>, above array<int>, length array<double>"
_SCORE = "tenant_bank_id string, segment string, snapshot_id string, anomaly double"


class UpgradedTierError(RuntimeError):
    """A party has enough history to need a model of its own, which is not built."""


def party_tiers(snapshots: DataFrame) -> DataFrame:
    """Total observations per party and the model tier they call for."""
    totals = snapshots.groupBy(*SEGMENT, "party_id").agg(F.sum("transaction_count").alias("observations"))
    return totals.withColumn("tier", observation_tier(F.col("observations")))


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy(*SEGMENT).agg(
        *(F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("SEGMENT_BASELINE", "ENTITY_SPECIFIC", "FULL_MODEL"))
    )


def upgraded_parties(snapshots: DataFrame) -> DataFrame:
    """Parties that have outgrown the segment model, which scores and clusters them all the same."""
    return party_tiers(snapshots).filter(F.col("tier") != "SEGMENT_BASELINE")


def check_tiers(snapshots: DataFrame) -> None:
    """Raise where any party has outgrown the segment model."""
    upgraded = upgraded_parties(snapshots).limit(1).collect()
    if upgraded:
        raise UpgradedTierError(f"{upgraded[0]['party_id']} needs a {upgraded[0]['tier']} model")


def segment_scores(snapshots: DataFrame, on_upgraded_tier: str = "error") -> DataFrame:
    """Rescaled score of every snapshot under its segment's forest.

    Parties with enough history for a model of their own are refused, or with
    ``on_upgraded_tier="baseline"`` scored by the segment's; ``upgraded_parties``
    lists them.
    """
    if on_upgraded_tier == "error":
        check_tiers(snapshots)
    elif on_upgraded_tier != "baseline":
        raise ValueError(f"on_upgraded_tier must be error or baseline, not {on_upgraded_tier}")
    rows = stored(forest_vectors(snapshots), "forest_vectors")
    models = stored(forest_models(tree_samples(rows)), "forest_models")
    return rescaled(stored(forest_scores(rows, models), "forest_raw"))


def tree_samples(vectors: DataFrame, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Up to ``sample_rows`` training rows per segment and tree.

    A row joins a tree where its hash falls below a threshold that lets about
    twice the sample through; the smallest hashes are kept.
    """
    training = training_rows(vectors)
    sizes = training.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("n") <= 2 * sample_rows, 1.0).otherwise(2.0 * sample_rows / F.col("n"))

    def fraction(tree):
        hashed = F.xxhash64(F.lit(seed), tree, "snapshot_id")
        return F.shiftrightunsigned(hashed, 11) / float(2**53)

    joined = join_small(training, sizes, SEGMENT).withColumn("share", share)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: fraction(t) < F.col("share"))
    drawn = joined.select(*SEGMENT, "snapshot_id", "x", F.explode(chosen).alias("tree"))
    order = Window.partitionBy(*SEGMENT, "tree").orderBy(fraction(F.col("tree")), "snapshot_id")
    ranked = drawn.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= sample_rows)


def _average_path(rows: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``rows`` values."""
    rows = np.asarray(rows, dtype=float)
    safe = np.maximum(rows, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(rows <= 1, 0.0, np.where(rows <= 2, 1.0, long))


def _grow(sample: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One tree: random feature and cut until a row is alone or the depth limit is met."""
    sample = sample.sort_values("rank")
    tenant, segment, tree = sample["tenant_bank_id"].iloc[0], sample["segment"].iloc[0], int(sample["tree"].iloc[0])
    x = np.stack(sample["x"].to_numpy())
    random = np.random.default_rng([seed, tree, zlib.crc32(f"{tenant}|{segment}".encode())])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, cut, below, above, length = [-1], [0.0], [-1], [-1], [0.0]
    pending = [(0, np.arange(len(x)), 0)]
    while pending:
        node, rows, depth = pending.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(varying) == 0:
            length[node] = depth + float(_average_path(len(rows)))
            continue
        f = int(random.choice(varying))
        c = float(random.uniform(low[f], high[f]))
        under = x[rows, f] <= c
        feature[node], cut[node] = f, c
        for side, part in ((below, rows[under]), (above, rows[~under])):
            side[node] = len(feature)
            for column, empty in ((feature, -1), (cut, 0.0), (below, -1), (above, -1), (length, 0.0)):
                column.append(empty)
            pending.append((side[node], part, depth + 1))
    return pd.DataFrame(
        {
            "tenant_bank_id": [tenant],
            "segment": [segment],
            "tree": [tree],
            "sample_rows": [len(x)],
            "feature": [feature],
            "cut": [cut],
            "below": [below],
            "above": [above],
            "length": [length],
        }
    )


def forest_models(samples: DataFrame, seed: int = SEED) -> DataFrame:
    """One row of node arrays per segment and tree."""
    return samples.groupBy(*SEGMENT, "tree").applyInPandas(lambda sample: _grow(sample, seed), _TREE)


def _score(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame({c: [] for c in ("tenant_bank_id", "segment", "snapshot_id", "anomaly")})
    x = np.stack(rows["x"].to_numpy())
    total = np.zeros(len(x))
    every = np.arange(len(x))
    models = models.sort_values("tree")
    for model in models.itertuples():
        feature, cut = np.asarray(model.feature), np.asarray(model.cut)
        below, above = np.asarray(model.below), np.asarray(model.above)
        node = np.zeros(len(x), dtype=int)
        inner = feature[node] >= 0
        while inner.any():
            at, row = node[inner], every[inner]
            under = x[row, feature[at]] <= cut[at]
            node[inner] = np.where(under, below[at], above[at])
            inner = feature[node] >= 0
        total += np.asarray(model.length)[node]
    scale = max(float(_average_path(models["sample_rows"].iloc[0])), 1e-12)
    anomaly = 2.0 ** (-(total / len(models)) / scale)
    return rows[["tenant_bank_id", "segment", "snapshot_id"]].assign(anomaly=anomaly)


def forest_scores(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Raw anomaly in (0, 1] per snapshot; higher is more anomalous."""
    return map_chunks(vectors.drop("split"), models, SEGMENT, "snapshot_id", _score, _SCORE)


def rescaled(scores: DataFrame) -> DataFrame:
    """Position of each row among its segment's scores on a 0-100 scale; 0 for a lone row."""
    sizes = scores.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranks.row_rank(
        scores, list(SEGMENT), "anomaly", "snapshot_id", "position", ranks.unit_bucket(F.col("anomaly"))
    )
    score = F.when(F.col("n") > 1, 100.0 * F.col("position") / (F.col("n") - 1)).otherwise(0.0)
    return join_small(ranked, sizes, SEGMENT).select("snapshot_id", *SEGMENT, score.alias("isolation_forest_score"))


def score_summary(snapshots: DataFrame, scores: DataFrame) -> DataFrame:
    """Parties, rows and score range per segment."""
    parties = snapshots.groupBy(*SEGMENT).agg(
        F.count_distinct("party_id").alias("parties"), F.count_if(F.col("split") == "train").alias("train_rows")
    )
    middle = ranks.median(scores, list(SEGMENT), "isolation_forest_score", "score_median")
    spread = scores.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.min("isolation_forest_score").alias("score_min"),
        F.max("isolation_forest_score").alias("score_max"),
    )
    return parties.join(spread, list(SEGMENT)).join(middle, list(SEGMENT))
