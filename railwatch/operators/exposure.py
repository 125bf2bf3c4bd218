"""Dollar claims and the exposure views built on them."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.dates import day_in_range, text_in_range
from railwatch.functions.scalars import labelled, week_start
from railwatch.operators.review import REVIEW_KEY
from railwatch.schema import (
    CONFIRMED,
    DISMISSED,
    FLAGGED_BANDS,
    FRAUD,
    OPERATIONAL,
    RECONCILIATION,
    SPIKE_ISSUES,
)

# Display texts of the domains.
DOMAIN_LABELS = {FRAUD: "Fraud / Anomaly", RECONCILIATION: "Reconciliation", OPERATIONAL: "Operational Issues"}
HEATMAP_LABELS = {OPERATIONAL: "Operational", RECONCILIATION: "Reconciliation"}


def claims(
    issues_with_events: DataFrame,
    breaks_with_events: DataFrame,
    snapshots: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """One row per claim that has a dollar amount; rate spikes have none."""
    fraud = snapshots.filter(F.col("anomaly_band").isin(*FLAGGED_BANDS)).select(
        F.lit(FRAUD).alias("signal_type"),
        "tenant_bank_id",
        F.col("snapshot_id").alias("reference_id"),
        F.coalesce("amount_total", F.lit(0.0)).alias("amount"),
        F.lit(None).cast("string").alias("rail_type"),
        F.col("window_end").alias("occurred_ts"),
    )
    breaks = breaks_with_events.select(
        F.lit(RECONCILIATION).alias("signal_type"),
        "tenant_bank_id",
        F.col("break_id").alias("reference_id"),
        F.coalesce(F.abs("amount"), F.lit(0.0)).alias("amount"),
        "rail_type",
        "occurred_ts",
    )
    operational = issues_with_events.filter(~F.col("issue_type").isin(*SPIKE_ISSUES)).select(
        F.lit(OPERATIONAL).alias("signal_type"),
        "tenant_bank_id",
        F.col("issue_id").alias("reference_id"),
        F.coalesce("total_amount", F.lit(0.0)).alias("amount"),
        F.col("first_event.rail_type").alias("rail_type"),
        F.col("first_event.occurred_ts").alias("occurred_ts"),
    )
    united = reduce(DataFrame.unionByName, (fraud, breaks, operational))
    scoped = united.filter(day_in_range(F.col("occurred_ts"), start, end))
    return scoped.withColumn("week_start", week_start(F.col("occurred_ts")))


def _with_domains(totals: DataFrame, tenants: DataFrame) -> DataFrame:
    """Every domain for every tenant, zero where a domain has no claims."""
    domains = F.explode(F.array(*(F.lit(d) for d in DOMAIN_LABELS))).alias("signal_type")
    every = tenants.select("tenant_bank_id").distinct().select("tenant_bank_id", domains)
    joined = every.join(totals, ["tenant_bank_id", "signal_type"], "left").fillna(0.0)
    return joined.withColumn("label", labelled(DOMAIN_LABELS, F.col("signal_type")))


def exposure_by_domain(claim_rows: DataFrame, tenants: DataFrame) -> DataFrame:
    totals = claim_rows.groupBy("tenant_bank_id", "signal_type").agg(F.bround(F.sum("amount"), 2).alias("exposure"))
    return _with_domains(totals, tenants)


def exposure_trend(claim_rows: DataFrame) -> DataFrame:
    """Exposure per event week; claims without a time are left out."""
    placed = claim_rows.filter(F.col("week_start").isNotNull())
    return placed.groupBy("tenant_bank_id", "week_start").agg(F.bround(F.sum("amount"), 2).alias("exposure"))


def exposure_by_rail(claim_rows: DataFrame) -> DataFrame:
    railed = claim_rows.filter(F.col("rail_type").isNotNull())
    return railed.groupBy("tenant_bank_id", "rail_type").agg(F.bround(F.sum("amount"), 2).alias("exposure"))


def anomaly_heatmap(claim_rows: DataFrame) -> DataFrame:
    cells = claim_rows.filter(F.col("rail_type").isNotNull() & F.col("signal_type").isin(*HEATMAP_LABELS))
    category = labelled(HEATMAP_LABELS, F.col("signal_type")).alias("category")
    return cells.groupBy("tenant_bank_id", "rail_type", category).agg(F.count(F.lit(1)).alias("count"))


def _split_by_review(claim_rows: DataFrame, reviews: DataFrame) -> DataFrame:
    judged = claim_rows.join(reviews.select(*REVIEW_KEY, "status"), list(REVIEW_KEY), "left")
    return judged.withColumn("reviewed", F.coalesce(F.col("status").isin(CONFIRMED, DISMISSED), F.lit(False)))


def _mitigation_sums():
    return [
        F.coalesce(F.sum(F.when(~F.col("reviewed"), F.col("amount"))), F.lit(0.0)).alias("residual"),
        F.coalesce(F.sum(F.when(F.col("reviewed"), F.col("amount"))), F.lit(0.0)).alias("mitigated"),
    ]


def mitigation_progress(claim_rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed and unreviewed exposure per tenant."""
    sums = _split_by_review(claim_rows, reviews).groupBy("tenant_bank_id").agg(*_mitigation_sums())
    total = F.col("residual") + F.col("mitigated")
    return sums.select(
        "tenant_bank_id",
        F.bround("residual", 2).alias("residual"),
        F.bround("mitigated", 2).alias("mitigated"),
        F.bround(total, 2).alias("total"),
        F.when(total != 0, F.col("mitigated") / total).alias("effectiveness_rate"),
    )


def mitigation_by_domain(claim_rows: DataFrame, reviews: DataFrame, tenants: DataFrame) -> DataFrame:
    sums = _split_by_review(claim_rows, reviews).groupBy("tenant_bank_id", "signal_type").agg(*_mitigation_sums())
    rounded = sums.select(
        "tenant_bank_id",
        "signal_type",
        F.bround("residual", 2).alias("residual"),
        F.bround("mitigated", 2).alias("mitigated"),
    )
    return _with_domains(rounded, tenants)


def payment_value_by_rail(
    events: DataFrame, breaks_with_events: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Total, impacted (by breaks, at most the total) and protected value per rail."""
    scoped = events.filter(F.col("amount").isNotNull() & text_in_range(F.col("transaction_occurred_at"), start, end))
    totals = scoped.groupBy("tenant_bank_id", "rail_type").agg(F.sum("amount").alias("total"))
    hit = breaks_with_events.filter(day_in_range(F.col("occurred_ts"), start, end))
    impacts = hit.groupBy("tenant_bank_id", "rail_type").agg(F.sum(F.abs("amount")).alias("broken"))
    impacted = F.least(F.coalesce("broken", F.lit(0.0)), F.col("total"))
    return totals.join(impacts, ["tenant_bank_id", "rail_type"], "left").select(
        "tenant_bank_id",
        "rail_type",
        F.bround("total", 2).alias("total_amount"),
        F.bround(F.col("total") - impacted, 2).alias("protected_amount"),
        F.bround(impacted, 2).alias("impacted_amount"),
    )


def touched_transactions(
    issues_with_events: DataFrame, breaks: DataFrame, overdue_batch_events: DataFrame
) -> DataFrame:
    """Keys of transactions that a break or a transaction or batch issue points at."""
    key = ["tenant_bank_id", "rail_type", "transaction_id"]
    singles = issues_with_events.filter(F.col("reference_type") == "TRANSACTION").select(
        "tenant_bank_id",
        F.col("first_event.rail_type").alias("rail_type"),
        F.col("first_event.transaction_id").alias("transaction_id"),
    )
    return breaks.select(*key).unionByName(singles).unionByName(overdue_batch_events.select(*key)).distinct()


def payment_normalcy(
    events: DataFrame, touched: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Share of transactions in the window that no finding touches."""
    key = ["tenant_bank_id", "rail_type", "transaction_id"]
    scoped = events.filter(text_in_range(F.col("transaction_occurred_at"), start, end)).select(*key)
    marked = scoped.join(touched.select(*key, F.lit(1).alias("hit")), key, "left")
    totals = marked.groupBy("tenant_bank_id").agg(
        F.count(F.lit(1)).alias("total_transactions"), F.count("hit").alias("touched_transactions")
    )
    return totals.withColumn(
        "rate", (F.col("total_transactions") - F.col("touched_transactions")) / F.col("total_transactions")
    )
