"""Analyst reviews: an append-only action log, its current state, and reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.functions.dates import day_in_range
from railwatch.schema import (
    CONFIRMED,
    DISMISSED,
    FLAGGED_BANDS,
    FRAUD,
    FUNNEL,
    FUNNEL_THRESHOLD,
    OPERATIONAL,
    PENDING,
    RECONCILIATION,
)

REVIEW_KEY = ("signal_type", "tenant_bank_id", "reference_id")
STATUSES = (PENDING, CONFIRMED, DISMISSED)

# Where a case alert came from -> the claim type its review belongs to.
ALERT_SIGNALS = {
    "OPERATIONAL_ISSUE": OPERATIONAL,
    "RECONCILIATION_BREAK": RECONCILIATION,
    "ANOMALY_SNAPSHOT": FRAUD,
}
CASE_DECISIONS = {"VALID": CONFIRMED, "INVALID": DISMISSED, "PENDING": PENDING}


def review_actions(actions: DataFrame) -> DataFrame:
    """Validated log rows; an unknown status fails, and PENDING clears the review time."""
    bad = ~F.col("status").isin(*STATUSES) | F.col("status").isNull()
    message = F.concat(F.lit("unknown review status: "), F.coalesce("status", F.lit("null")))
    status = F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("status"))
    return actions.select(
        *REVIEW_KEY,
        status.alias("status"),
        "reviewed_by",
        "notes",
        F.when(F.col("status") != PENDING, F.col("acted_at")).alias("reviewed_at"),
        "acted_at",
    )


def current_reviews(log: DataFrame) -> DataFrame:
    """The latest action per claim."""
    latest = log.groupBy(*REVIEW_KEY).agg(
        F.max_by(F.struct("status", "reviewed_by", "notes", "reviewed_at"), "acted_at").alias("row")
    )
    return latest.select(*REVIEW_KEY, "row.*")


def case_validation_actions(decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Log rows that carry a case decision to every alert of the case."""
    known = F.col("validation_status").isin(*CASE_DECISIONS)
    checked = decisions.withColumn(
        "validation_status",
        F.when(known, F.col("validation_status")).otherwise(F.raise_error(F.lit("unknown validation status")).cast("string")),
    )
    sources = alerts.filter(F.col("source_type").isin(*ALERT_SIGNALS))
    status = _from_table(CASE_DECISIONS, "validation_status")
    return sources.join(checked, ["tenant_bank_id", "case_code"]).select(
        _from_table(ALERT_SIGNALS, "source_type").alias("signal_type"),
        "tenant_bank_id",
        F.col("source_id").alias("reference_id"),
        status.alias("status"),
        "reviewed_by",
        F.lit(None).cast("string").alias("notes"),
        F.when(status != PENDING, F.col("acted_at")).alias("reviewed_at"),
        "acted_at",
    )


def _from_table(table: dict[str, str], key: str):
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(key))


def claim_ids(
    issues: DataFrame,
    breaks: DataFrame,
    snapshots: DataFrame,
    beneficiaries: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Every reviewable claim. A window compares each claim's own event time.

    ``issues`` and ``breaks`` need ``occurred_ts`` only where a window is given.
    """
    flagged = snapshots.filter(F.col("anomaly_band").isin(*FLAGGED_BANDS))
    funnels = beneficiaries.filter(F.col("funnel_drift_score") >= FUNNEL_THRESHOLD)
    sources = (
        (issues, OPERATIONAL, "issue_id", "occurred_ts"),
        (breaks, RECONCILIATION, "break_id", "occurred_ts"),
        (flagged, FRAUD, "snapshot_id", "window_end"),
        (funnels, FUNNEL, "snapshot_id", "window_end"),
    )
    windowed = start is not None or end is not None
    parts = []
    for rows, signal, identity, when in sources:
        scoped = rows.filter(day_in_range(F.col(when), start, end)) if windowed else rows
        parts.append(scoped.select(F.lit(signal).alias("signal_type"), "tenant_bank_id", F.col(identity).alias("reference_id")))
    return reduce(DataFrame.unionByName, parts)


def review_counts(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims and review outcomes per tenant and claim type; types without claims are absent.

    A review counts only while its claim does.
    """
    judged = claims.join(reviews.select(*REVIEW_KEY, "status"), list(REVIEW_KEY), "left")
    return judged.groupBy("tenant_bank_id", "signal_type").agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(F.col("status") == CONFIRMED).alias("confirmed"),
        F.count_if(F.col("status") == DISMISSED).alias("dismissed"),
    )


def review_summary_by_type(counts: DataFrame) -> DataFrame:
    """One row per tenant and claim type, with zeros for types without claims."""
    types = F.explode(F.array(*(F.lit(s) for s in (OPERATIONAL, RECONCILIATION, FRAUD, FUNNEL)))).alias("signal_type")
    every = counts.select("tenant_bank_id").distinct().select("tenant_bank_id", types)
    filled = every.join(counts, ["tenant_bank_id", "signal_type"], "left").fillna(0)
    reviewed = F.col("confirmed") + F.col("dismissed")
    return filled.select(
        "tenant_bank_id",
        "signal_type",
        "total_claims",
        reviewed.alias("reviewed"),
        F.greatest(F.lit(0), F.col("total_claims") - reviewed).alias("pending"),
    )


def review_summary(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("tenant_bank_id").agg(
        F.sum("total_claims").alias("total_claims"),
        F.sum("confirmed").alias("confirmed"),
        F.sum("dismissed").alias("dismissed"),
    )
    reviewed = F.col("confirmed") + F.col("dismissed")
    return totals.select(
        "*",
        F.greatest(F.lit(0), F.col("total_claims") - reviewed).alias("pending"),
        F.when(F.col("total_claims") > 0, F.bround(reviewed / F.col("total_claims"), 3)).alias("review_rate"),
    )


def _judged(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("status").isin(CONFIRMED, DISMISSED) & F.col("reviewed_at").isNotNull())


def quality_trend(reviews: DataFrame) -> DataFrame:
    """Confirmed and dismissed shares after each review, in review order.

    Reviews of one instant (a decision on a large case) are ordered by a hash
    of their claim, which lets the running counts be built in pieces.
    """
    judged = _judged(reviews)
    levels = {
        "day": ranks.day_bucket(F.col("reviewed_at")),
        "instant": F.col("reviewed_at"),
        "tie": ranks.tie_bucket("signal_type", "reference_id"),
    }
    counted = ranks.running_totals(
        judged,
        ["tenant_bank_id"],
        levels,
        ["signal_type", "reference_id"],
        {
            "confirmed_so_far": (F.col("status") == CONFIRMED).cast("long"),
            "dismissed_so_far": (F.col("status") == DISMISSED).cast("long"),
        },
    )
    reviewed = F.col("confirmed_so_far") + F.col("dismissed_so_far")
    return counted.select(
        *REVIEW_KEY,
        "reviewed_at",
        (F.col("confirmed_so_far") / reviewed).alias("confirmation_rate"),
        (F.col("dismissed_so_far") / reviewed).alias("false_positive_rate"),
        reviewed.alias("reviewed_count"),
    )


def quality_trend_daily(reviews: DataFrame, days: int = 7) -> DataFrame:
    """Outcomes per day over the last ``days`` days up to each tenant's latest review."""
    daily = (
        _judged(reviews)
        .groupBy("tenant_bank_id", F.to_date("reviewed_at").alias("date"))
        .agg(
            F.count_if(F.col("status") == CONFIRMED).alias("confirmed"),
            F.count_if(F.col("status") == DISMISSED).alias("dismissed"),
        )
    )
    latest = daily.groupBy("tenant_bank_id").agg(F.max("date").alias("latest"))
    recent = F.col("date") >= F.date_sub("latest", days - 1)
    return daily.join(latest, "tenant_bank_id").filter(recent).drop("latest")
