"""Final anomaly score, category tags and the mix of known and new patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.functions.joins import join_small
from railwatch.functions.scalars import anomaly_band, cluster_signal
from railwatch.schema import FLAGGED_BANDS, FUNNEL_THRESHOLD

# Weights of the three signals.
FOREST_WEIGHT = 0.40
CLUSTER_WEIGHT = 0.25
DRIFT_WEIGHT = 0.35

# Tag -> snapshot column that is compared with its segment's p75.
TAG_FEATURES = {
    "New Payee Risk": "new_counterparty_ratio",
    "Structuring": "near_threshold_ratio",
    "Velocity Checks": "timeseries_drift_score",
}
TAG_FRACTION = 0.75
SEGMENT = ("tenant_bank_id", "segment")


def with_final_score(snapshots: DataFrame) -> DataFrame:
    """Combine forest, cluster change and drift; a row without a forest score is an error."""
    forest = F.col("isolation_forest_score")
    checked = F.when(
        forest.isNull(), F.raise_error(F.concat(F.lit("missing isolation_forest_score for "), "snapshot_id")).cast("double")
    ).otherwise(forest)
    score = (
        FOREST_WEIGHT * checked
        + CLUSTER_WEIGHT * cluster_signal(F.col("cluster_changed"))
        + DRIFT_WEIGHT * F.coalesce("timeseries_drift_score", F.lit(0.0))
    )
    return with_band(snapshots, score)


def with_band(snapshots: DataFrame, score: Column) -> DataFrame:
    return snapshots.withColumn("final_anomaly_score", score).withColumn(
        "anomaly_band", anomaly_band(F.col("final_anomaly_score"))
    )


def tag_thresholds(snapshots: DataFrame) -> DataFrame:
    """One row per tenant and segment with the p75 of each tag's feature."""
    features = F.explode(
        F.create_map(*(part for c in TAG_FEATURES.values() for part in (F.lit(c), F.col(c).cast("double"))))
    ).alias("feature", "value")
    long = snapshots.select(*SEGMENT, features)
    picked = ranks.at_index_fraction(long, [*SEGMENT, "feature"], "value", TAG_FRACTION, "threshold")
    return picked.groupBy(*SEGMENT).agg(
        *(F.max(F.when(F.col("feature") == c, F.col("threshold"))).alias(f"p75_{c}") for c in TAG_FEATURES.values())
    )


def with_tags(snapshots: DataFrame) -> DataFrame:
    """Add ``categories``: the tags whose feature reaches a positive p75 of its segment."""
    joined = join_small(snapshots, tag_thresholds(snapshots), SEGMENT, "left")
    tags = [
        F.when((F.col(f"p75_{c}") > 0) & (F.col(c) >= F.col(f"p75_{c}")), F.lit(label))
        for label, c in TAG_FEATURES.items()
    ]
    return joined.withColumn("categories", F.array_compact(F.array(*tags))).drop(
        *(f"p75_{c}" for c in TAG_FEATURES.values())
    )


def with_funnel_tag(beneficiaries: DataFrame) -> DataFrame:
    tag = F.when(F.col("funnel_drift_score") >= FUNNEL_THRESHOLD, F.lit("Funnel Account"))
    return beneficiaries.withColumn("categories", F.array_compact(F.array(tag)))


def pattern_mix(tagged_snapshots: DataFrame, beneficiaries: DataFrame) -> DataFrame:
    """Flagged rows per tenant that carry a tag (known) or none (newly discovered)."""
    flagged = tagged_snapshots.filter(F.col("anomaly_band").isin(*FLAGGED_BANDS)).select(
        "tenant_bank_id", (F.size("categories") > 0).alias("known")
    )
    funnels = beneficiaries.filter(F.col("funnel_drift_score") >= FUNNEL_THRESHOLD).select(
        "tenant_bank_id", F.lit(True).alias("known")
    )
    tenants = tagged_snapshots.select("tenant_bank_id").distinct()
    counts = (
        flagged.unionByName(funnels)
        .groupBy("tenant_bank_id")
        .agg(F.count_if("known").alias("known_count"), F.count_if(~F.col("known")).alias("newly_discovered_count"))
    )
    total = F.col("known_count") + F.col("newly_discovered_count")
    return (
        tenants.join(counts, "tenant_bank_id", "left")
        .fillna(0, ["known_count", "newly_discovered_count"])
        .withColumn("total", total)
        .withColumn("known_rate", F.when(total > 0, F.col("known_count") / total))
        .withColumn("newly_discovered_rate", F.when(total > 0, F.col("newly_discovered_count") / total))
    )
