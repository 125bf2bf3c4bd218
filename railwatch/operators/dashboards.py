"""Read-side aggregates per tenant."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.functions.dates import day_in_range, text_in_range
from railwatch.schema import OPERATIONAL, PROVISIONAL_VARIANCE, RECONCILIATION, SETTLED

TENANT_RAIL = ("tenant_bank_id", "rail_type")
ATTENTION_GAP = 0.05


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def overview(
    events: DataFrame,
    merchants: DataFrame,
    individuals: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Transaction, settlement and registry counts; the date range is never scoped."""
    in_window = text_in_range(F.col("transaction_occurred_at"), start, end)
    totals = events.groupBy("tenant_bank_id").agg(
        F.count_if(in_window).alias("total_transactions"),
        F.count_if(in_window & (F.col("status") == SETTLED)).alias("settled_transactions"),
        F.min("transaction_occurred_at").alias("date_range_start"),
        F.max("transaction_occurred_at").alias("date_range_end"),
    )
    parties = [
        registry.groupBy("tenant_bank_id").agg(F.count(F.lit(1)).alias(name))
        for registry, name in ((merchants, "total_merchants"), (individuals, "total_individuals"))
    ]
    joined = reduce(lambda left, right: left.join(right, "tenant_bank_id", "left"), parties, totals)
    rate = _rate(F.col("settled_transactions"), F.col("total_transactions"))
    return joined.fillna(0, ["total_merchants", "total_individuals"]).withColumn("settlement_rate", rate)


def finding_counts(
    snapshots: DataFrame,
    issues: DataFrame,
    breaks: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Counts of bands, issue types and break types, scoped by each finding's event time."""
    parts = (
        (snapshots.filter(F.col("anomaly_band").isNotNull()), "anomaly_band", "anomaly_band", "window_end"),
        (issues, "operational_issue", "issue_type", "occurred_ts"),
        (breaks, "reconciliation_break", "detection_type", "occurred_ts"),
    )
    return reduce(
        DataFrame.unionByName,
        [
            rows.filter(day_in_range(F.col(when), start, end))
            .groupBy("tenant_bank_id", F.lit(kind).alias("kind"), F.col(name).alias("name"))
            .agg(F.count(F.lit(1)).alias("count"))
            for rows, kind, name, when in parts
        ],
    )


def status_breakdown(events: DataFrame) -> DataFrame:
    status = F.when(F.col("status") != "", F.col("status"))
    return events.groupBy("tenant_bank_id", F.coalesce(status, F.lit("UNKNOWN")).alias("status")).agg(
        F.count(F.lit(1)).alias("transaction_count")
    )


def rail_stats(
    events: DataFrame, breaks_with_events: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    scoped = events.filter(text_in_range(F.col("transaction_occurred_at"), start, end))
    rails = scoped.groupBy(*TENANT_RAIL).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_if(F.col("status") == SETTLED).alias("settled_count"),
        F.sum("amount").alias("total_amount"),
    )
    hit = breaks_with_events.filter(day_in_range(F.col("occurred_ts"), start, end))
    counts = hit.groupBy(*TENANT_RAIL).agg(F.count(F.lit(1)).alias("reconciliation_break_count"))
    joined = rails.join(counts, list(TENANT_RAIL), "left").fillna(0, ["reconciliation_break_count"])
    return joined.withColumn("settlement_rate", _rate(F.col("settled_count"), F.col("transaction_count")))


def senior_overview(totals: DataFrame, health: DataFrame, review: DataFrame, findings: DataFrame) -> DataFrame:
    """Health, review completion and finding counts beside the transaction totals.

    Finding counts become one map per tenant; the kinds and names are a fixed
    vocabulary, so the map is small.
    """
    pairs = F.struct(F.concat_ws(":", "kind", "name").alias("key"), F.col("count").alias("value"))
    maps = findings.groupBy("tenant_bank_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(pairs))).alias("engine_totals")
    )
    health_columns = health.select(
        "tenant_bank_id",
        "health_score",
        "health_band",
        *(c for c in health.columns if c.endswith("_component")),
        F.col("computed_at").alias("health_computed_at"),
    )
    review_columns = review.select("tenant_bank_id", "total_claims", "confirmed", "dismissed", "pending", "review_rate")
    joined = totals.select(
        "tenant_bank_id", "total_transactions", "settlement_rate", "date_range_start", "date_range_end"
    )
    for part in (health_columns, review_columns, maps):
        joined = joined.join(part, "tenant_bank_id", "left")
    return joined


def detection_latencies(
    issues_with_events: DataFrame,
    breaks_with_events: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Seconds from event to detection for findings with a transaction; negatives are dropped."""
    issues = issues_with_events.filter(F.col("reference_type") == "TRANSACTION").select(
        "tenant_bank_id",
        F.col("first_event.rail_type").alias("rail_type"),
        F.col("first_event.occurred_ts").alias("occurred_ts"),
        "detected_at",
    )
    breaks = breaks_with_events.select(*TENANT_RAIL, "occurred_ts", "detected_at")
    timed = issues.unionByName(breaks).filter(
        F.col("occurred_ts").isNotNull() & day_in_range(F.col("occurred_ts"), start, end)
    )
    seconds = (F.unix_micros("detected_at") - F.unix_micros("occurred_ts")) / 1_000_000
    return timed.withColumn("latency_seconds", seconds).filter(F.col("latency_seconds") >= 0)


def median_latency(latencies: DataFrame, keys: tuple[str, ...] = ("tenant_bank_id",)) -> DataFrame:
    return ranks.median(latencies, list(keys), "latency_seconds", "median_detection_seconds")


def detection_volume(
    snapshots: DataFrame,
    issues: DataFrame,
    breaks: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Findings per engine and their share of all findings of the tenant."""
    categories = {"anomaly_band": "Fraud", OPERATIONAL: "Operational", RECONCILIATION: "Reconciliation"}
    counts = finding_counts(snapshots, issues, breaks, start, end)
    columns = [
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0)).alias(label)
        for kind, label in categories.items()
    ]
    wide = counts.groupBy("tenant_bank_id").agg(*columns, F.sum("count").alias("total"))
    long = wide.unpivot(["tenant_bank_id", "total"], list(categories.values()), "category", "count")
    return long.select("tenant_bank_id", "category", "count", _rate(F.col("count"), F.col("total")).alias("percentage"))


def detection_performance_by_rail(
    events: DataFrame,
    issues_with_events: DataFrame,
    breaks_with_events: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Share of each rail's transactions that no finding names, and the median latency."""
    issues = issues_with_events.filter(F.col("reference_type") == "TRANSACTION").select(
        "tenant_bank_id",
        F.col("first_event.rail_type").alias("rail_type"),
        F.col("reference_id").alias("transaction_id"),
        F.col("first_event.occurred_ts").alias("occurred_ts"),
    )
    breaks = breaks_with_events.select(*TENANT_RAIL, "transaction_id", "occurred_ts")
    named = issues.unionByName(breaks).filter(day_in_range(F.col("occurred_ts"), start, end))
    flagged = named.groupBy(*TENANT_RAIL).agg(F.count_distinct("transaction_id").alias("flagged"))
    rails = events.groupBy(*TENANT_RAIL).agg(
        F.count_if(text_in_range(F.col("transaction_occurred_at"), start, end)).alias("rail_total")
    )
    medians = median_latency(detection_latencies(issues_with_events, breaks_with_events, start, end), TENANT_RAIL)
    joined = rails.join(flagged, list(TENANT_RAIL), "left").join(medians, list(TENANT_RAIL), "left")
    success = F.when(F.col("rail_total") > 0, 1 - F.coalesce("flagged", F.lit(0)) / F.col("rail_total"))
    return joined.select(*TENANT_RAIL, success.alias("success_rate"), "median_detection_seconds")


def new_patterns(issues: DataFrame, breaks: DataFrame, recent_days: int = 7) -> DataFrame:
    """Finding types per tenant first detected within ``recent_days`` of the latest detection."""
    seen = issues.select("tenant_bank_id", F.col("issue_type").alias("name"), "detected_at").unionByName(
        breaks.select("tenant_bank_id", F.col("detection_type").alias("name"), "detected_at")
    )
    types = seen.groupBy("tenant_bank_id", "name").agg(
        F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen")
    )
    latest = types.groupBy("tenant_bank_id").agg(F.max("last_seen").alias("latest"))
    recent = F.col("first_seen") >= F.col("latest") - F.make_dt_interval(F.lit(recent_days))
    return (
        types.join(latest, "tenant_bank_id")
        .groupBy("tenant_bank_id")
        .agg(F.count_if(recent).alias("new_patterns_detected"))
    )


def coverage(events: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Share of transactions with a resolved party, per rail and (rail null) per tenant."""
    in_window = text_in_range(F.col("transaction_occurred_at"), start, end)
    resolved = F.col("merchant_id").isNotNull() | F.col("individual_id").isNotNull()
    rails = events.groupBy(*TENANT_RAIL).agg(
        F.count_if(in_window).alias("total_transactions"),
        F.count_if(in_window & resolved).alias("covered_transactions"),
    )
    overall = rails.groupBy("tenant_bank_id").agg(
        F.lit(None).cast("string").alias("rail_type"),
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("covered_transactions").alias("covered_transactions"),
    )
    rate = _rate(F.col("covered_transactions"), F.col("total_transactions"))
    return rails.unionByName(overall).withColumn("coverage_rate", rate)


def early_exposure(
    breaks_with_events: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Provisional variances per tenant: how many, and the amount behind them."""
    early = breaks_with_events.filter(
        (F.col("detection_type") == PROVISIONAL_VARIANCE) & day_in_range(F.col("occurred_ts"), start, end)
    )
    return early.groupBy("tenant_bank_id").agg(
        F.count(F.lit(1)).alias("provisional_variance_count"),
        F.bround(F.coalesce(F.sum(F.abs("amount")), F.lit(0.0)), 2).alias("exposure_identified_early"),
    )


def detection_performance(
    coverage_rows: DataFrame,
    early: DataFrame,
    review: DataFrame,
    latencies: DataFrame,
    patterns: DataFrame,
    mix: DataFrame,
) -> DataFrame:
    """The headline row per tenant; the per-rail, per-category and trend tables stand beside it."""
    overall = coverage_rows.filter(F.col("rail_type").isNull()).drop("rail_type")
    reviewed = F.col("confirmed") + F.col("dismissed")
    rates = review.select(
        "tenant_bank_id",
        _rate(F.col("confirmed"), reviewed).alias("confirmation_rate"),
        _rate(F.col("dismissed"), reviewed).alias("false_positive_rate"),
        reviewed.alias("reviewed_count"),
        F.col("pending").alias("pending_count"),
        F.col("confirmed").alias("confirmed_count"),
        F.col("dismissed").alias("dismissed_count"),
    )
    joined = overall
    for part in (early, rates, median_latency(latencies), patterns, mix.select("tenant_bank_id", "known_count", "newly_discovered_count", "known_rate", "newly_discovered_rate")):
        joined = joined.join(part, "tenant_bank_id", "left")
    counts = ["provisional_variance_count", "exposure_identified_early", "reviewed_count", "pending_count"]
    counts += ["confirmed_count", "dismissed_count", "new_patterns_detected"]
    return joined.fillna(0, counts)


def priority_distribution(
    snapshots: DataFrame,
    ranked_issues: DataFrame,
    ranked_breaks: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Findings per tenant at each of the four levels; Normal snapshots are not findings."""
    band = F.col("anomaly_band")
    level = F.when(band == "Low-Medium", "Medium").when(band.isin("High", "Critical"), band)
    parts = [
        snapshots.filter(day_in_range(F.col("window_end"), start, end)).select("tenant_bank_id", level.alias("level")),
        *(
            rows.filter(day_in_range(F.col("occurred_ts"), start, end)).select(
                "tenant_bank_id", F.col("priority_level").alias("level")
            )
            for rows in (ranked_issues, ranked_breaks)
        ),
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("tenant_bank_id")
        .agg(*(F.count_if(F.col("level") == name).alias(name.lower()) for name in ("Critical", "High", "Medium", "Low")))
    )


def detection_attention(by_rail: DataFrame) -> DataFrame:
    """Rails below their tenant's mean success rate; high where more than 5 points below."""
    means = by_rail.groupBy("tenant_bank_id").agg(F.avg("success_rate").alias("average"))
    below = by_rail.join(means, "tenant_bank_id").filter(F.col("success_rate") < F.col("average"))
    severity = F.when(F.col("success_rate") < F.col("average") - ATTENTION_GAP, "high").otherwise("medium")
    reason = F.format_string(
        "%.1f%% succeed on this rail, %.1f%% on average over the tenant's rails",
        F.col("success_rate") * 100.0,
        F.col("average") * 100.0,
    )
    return below.select(*TENANT_RAIL, "success_rate", "average", reason.alias("reason"), severity.alias("severity"))
