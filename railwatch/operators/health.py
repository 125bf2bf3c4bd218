"""Payment health per tenant, its history and its current row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.scalars import health_band
from railwatch.schema import SETTLED

# Weight of each component, and of a Critical row against a High one.
WEIGHTS = {"settlement": 0.30, "anomaly": 0.30, "operational": 0.20, "reconciliation": 0.20}
CRITICAL_WEIGHT = 2


def _count_by_tenant(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("tenant_bank_id").agg(F.count(F.lit(1)).alias(name))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def health_scores(
    events: DataFrame, snapshots: DataFrame, issues: DataFrame, breaks: DataFrame, computed_at: dt.datetime
) -> DataFrame:
    """One row per tenant with events: score, band, components and the counts behind them."""
    counts = events.groupBy("tenant_bank_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("status") == SETTLED).alias("settled_transactions"),
        F.count("reconciliation_status").alias("reconciliation_checked"),
    )
    bands = snapshots.groupBy("tenant_bank_id").agg(
        F.count(F.lit(1)).alias("total_scored_entities"),
        F.count_if(F.col("anomaly_band") == "Critical").alias("critical_anomaly_count"),
        F.count_if(F.col("anomaly_band") == "High").alias("high_anomaly_count"),
    )
    joined = counts
    for part in (bands, _count_by_tenant(issues, "operational_issue_count"), _count_by_tenant(breaks, "reconciliation_break_count")):
        joined = joined.join(part, "tenant_bank_id", "left")
    joined = joined.fillna(0)

    total = F.col("total_transactions")
    weighted = F.col("critical_anomaly_count") * CRITICAL_WEIGHT + F.col("high_anomaly_count")
    penalties = {
        "settlement": F.greatest(F.lit(0.0), (1.0 - F.col("settled_transactions") / total) * 100.0),
        "anomaly": _percent(weighted, F.col("total_scored_entities")),
        "operational": _percent(F.col("operational_issue_count"), total),
        "reconciliation": _percent(F.col("reconciliation_break_count"), F.col("reconciliation_checked")),
    }
    components = {name: F.greatest(F.lit(0.0), 100.0 - penalty) for name, penalty in penalties.items()}
    raw = sum((components[name] * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)
    return joined.withColumn("health_score", score).select(
        "tenant_bank_id",
        "health_score",
        health_band(F.col("health_score")).alias("health_band"),
        *(F.bround(c, 1).alias(f"{name}_component") for name, c in components.items()),
        "total_transactions",
        "settled_transactions",
        "total_scored_entities",
        "critical_anomaly_count",
        "high_anomaly_count",
        "operational_issue_count",
        "reconciliation_break_count",
        F.lit(computed_at).cast("timestamp").alias("computed_at"),
    )


def history_rows(scores: DataFrame) -> DataFrame:
    """The rows a run appends to the history."""
    return scores.select("tenant_bank_id", "computed_at", "health_score", "health_band")


def health_history(history: DataFrame, points: int = 90) -> DataFrame:
    """The last ``points`` history rows of each tenant, oldest first.

    The history grows by one row per tenant and run, so the window is small.
    """
    newest = Window.partitionBy("tenant_bank_id").orderBy(F.col("computed_at").desc())
    return (
        history.withColumn("__newest", F.row_number().over(newest))
        .filter(F.col("__newest") <= points)
        .drop("__newest")
        .orderBy("tenant_bank_id", "computed_at")
    )


def current_health(log: DataFrame) -> DataFrame:
    """The latest full row of each tenant from an append-only log of runs."""
    columns = [c for c in log.columns if c != "tenant_bank_id"]
    latest = log.groupBy("tenant_bank_id").agg(F.max_by(F.struct(*columns), "computed_at").alias("row"))
    return latest.select("tenant_bank_id", "row.*")
