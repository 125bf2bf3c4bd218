"""Feature vectors of snapshots: imputed, standardised, projected."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.functions.joins import join_small

SEGMENT = ("tenant_bank_id", "segment")

# The features each model reads, in order.
CLUSTER_FEATURES = (
    "transaction_count",
    "amount_total",
    "amount_avg",
    "amount_median",
    "amount_std",
    "unique_counterparties",
    "new_counterparty_ratio",
    "retry_ratio",
    "avg_response_time_ms",
    "format_reject_ratio",
    "account_age_days",
)
STRUCTURING_FEATURES = (*CLUSTER_FEATURES, "near_threshold_ratio")
FOREST_FEATURES = (*CLUSTER_FEATURES[:9], "timeout_ratio", *CLUSTER_FEATURES[9:], "near_threshold_ratio")
PCA_SHARE = 0.90


def segment_medians(snapshots: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median of every feature per tenant and segment, 0 where all values are null."""
    pairs = F.create_map(*(part for f in features for part in (F.lit(f), F.col(f).cast("double"))))
    long = snapshots.select(*SEGMENT, F.explode(pairs).alias("feature", "value"))
    medians = ranks.median(long, [*SEGMENT, "feature"], "value", "median")
    wide = medians.groupBy(*SEGMENT).agg(
        *(F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"median_{f}") for f in features)
    )
    segments = snapshots.select(*SEGMENT).distinct()
    return segments.join(wide, list(SEGMENT), "left").fillna(0.0)


def training_rows(snapshots: DataFrame) -> DataFrame:
    """The train split of each segment, or all of a segment that has none."""
    has_train = snapshots.groupBy(*SEGMENT).agg(F.bool_or(F.col("split") == "train").alias("has_train"))
    marked = join_small(snapshots, has_train, SEGMENT)
    return marked.filter((F.col("split") == "train") | ~F.col("has_train")).drop("has_train")


def imputed(snapshots: DataFrame, features: Sequence[str], medians: DataFrame) -> DataFrame:
    """Snapshot id, segment, split and the vector ``x`` with nulls replaced by medians."""
    filled = [F.coalesce(F.col(f).cast("double"), F.col(f"median_{f}")) for f in features]
    return join_small(snapshots, medians, SEGMENT).select("snapshot_id", *SEGMENT, "split", F.array(*filled).alias("x"))


def standardised(vectors: DataFrame, width: int) -> DataFrame:
    """Scale each position to zero mean and unit population deviation per segment."""
    moments = vectors.groupBy(*SEGMENT).agg(
        F.array(*(F.avg(F.col("x")[i]) for i in range(width))).alias("mean"),
        F.array(*(F.stddev_pop(F.col("x")[i]) for i in range(width))).alias("deviation"),
        F.array(*((F.min(F.col("x")[i]) == F.max(F.col("x")[i])) for i in range(width))).alias("flat"),
    )
    scaled = [
        F.when(F.col("flat")[i], 0.0).otherwise((F.col("x")[i] - F.col("mean")[i]) / F.col("deviation")[i])
        for i in range(width)
    ]
    return join_small(vectors, moments, SEGMENT).select("snapshot_id", *SEGMENT, F.array(*scaled).alias("x"))


def _components(rows: pd.DataFrame, width: int, share: float) -> pd.DataFrame:
    """Leading eigenvectors of one segment's covariance that reach ``share`` of the variance."""
    row = rows.iloc[0]
    covariance = np.array(row["products"], dtype=float).reshape(width, width)
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values, directions = np.clip(values[order], 0.0, None), directions[:, order]
    kept = width
    if values.sum() > 0:
        reached = np.cumsum(values / values.sum())
        kept = min(int(np.searchsorted(reached, share)) + 1, width)
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(width)])
    components = (directions * signs).T[:kept]
    return pd.DataFrame(
        {"tenant_bank_id": [row["tenant_bank_id"]], "segment": [row["segment"]], "components": [components.tolist()]}
    )


def projected(scaled: DataFrame, width: int, share: float = PCA_SHARE) -> DataFrame:
    """Standardised vectors on the leading principal components of their segment.

    Spark sums the products of all positions; only one width-by-width matrix
    per segment is decomposed in Python.
    """
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(width) for j in range(width)]
    sums = scaled.groupBy(*SEGMENT).agg(F.array(*products).alias("products"))
    components = sums.groupBy(*SEGMENT).applyInPandas(
        lambda rows: _components(rows, width, share),
        "tenant_bank_id string, segment string, components array<array<double>>",
    )
    dot = F.transform(
        "components",
        lambda c: F.aggregate(F.zip_with(c, "x", lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v),
    )
    return join_small(scaled, components, SEGMENT).select("snapshot_id", *SEGMENT, dot.alias("x"))


def cluster_vectors(snapshots: DataFrame, include_structuring: bool = False) -> DataFrame:
    features = STRUCTURING_FEATURES if include_structuring else CLUSTER_FEATURES
    filled = imputed(snapshots, features, segment_medians(snapshots, features))
    scaled = standardised(filled, len(features))
    return projected(scaled, len(features)) if include_structuring else scaled


def forest_vectors(snapshots: DataFrame) -> DataFrame:
    """Vectors of all rows, with medians taken from the training rows."""
    medians = segment_medians(training_rows(snapshots), FOREST_FEATURES)
    return imputed(snapshots, FOREST_FEATURES, medians)
