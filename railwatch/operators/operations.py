"""Operational rules; each yields rows of the shared issue layout."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railwatch.functions.history import drift_score, earlier_rows, prior_count, prior_zscore
from railwatch.functions.scalars import iso_text, non_empty, parse_iso, timeout_severity
from railwatch.operators.drift import PARTY_WEEKS, merchant_weeks
from railwatch.schema import (
    BATCH_NOT_SETTLED,
    DUPLICATE_PAYMENT,
    FORMAT_REJECTION,
    FORMAT_REJECTION_SPIKE,
    NETWORK_TIMEOUT_SPIKE,
    SETTLED,
)

TIMEOUT_FLAG_Z = 2.0
REJECTION_SPIKE_SCORE = 60.0
RETRY_LINK = "RETRY-LINK:"

ISSUE_COLUMNS = (
    "issue_id",
    "issue_type",
    "tenant_bank_id",
    "reference_type",
    "reference_id",
    "window_start",
    "window_end",
    "severity_score",
    "days_overdue",
    "details",
    "detected_at",
)


def _issue(
    rows: DataFrame,
    issue_type: str,
    reference_type: str,
    detected_at: dt.datetime,
    identity: Column,
    details: Column,
    **columns: Column,
) -> DataFrame:
    absent = {
        "window_start": F.lit(None).cast("timestamp"),
        "window_end": F.lit(None).cast("timestamp"),
        "severity_score": F.lit(None).cast("double"),
        "days_overdue": F.lit(None).cast("long"),
    }
    values = {
        **absent,
        "issue_id": F.concat_ws("|", F.lit(issue_type), F.col("tenant_bank_id"), identity),
        "issue_type": F.lit(issue_type),
        "tenant_bank_id": F.col("tenant_bank_id"),
        "reference_type": F.lit(reference_type),
        "details": F.to_json(details),
        "detected_at": F.lit(detected_at).cast("timestamp"),
        **columns,
    }
    return rows.select(*(values[name].alias(name) for name in ISSUE_COLUMNS))


def _shared_key_groups(events: DataFrame) -> DataFrame:
    settled = F.col("status") == SETTLED
    return (
        events.filter(non_empty(F.col("idempotency_key")).isNotNull())
        .groupBy("tenant_bank_id", F.col("idempotency_key").alias("link_key"))
        .agg(
            F.count(F.lit(1)).alias("member_count"),
            F.count_if(settled).alias("settled_count"),
            F.min_by("transaction_id", F.when(settled, F.col("event_ordinal"))).alias("reference_id"),
        )
    )


def _retry_pairs(events: DataFrame) -> DataFrame:
    """Retries joined to the original they name, unless both share a key already.

    Where a transaction id occurs on several rails the last event stands for it.
    """
    columns = ["rail_type", "idempotency_key", "status", "event_ordinal"]
    originals = events.groupBy("tenant_bank_id", F.col("transaction_id").alias("original_id")).agg(
        F.max_by(F.struct(*columns), "event_ordinal").alias("original")
    )
    retries = events.filter(F.col("is_retry") & non_empty(F.col("original_transaction_id")).isNotNull()).select(
        "tenant_bank_id",
        F.col("original_transaction_id").alias("original_id"),
        "transaction_id",
        *columns,
    )
    shares_key = non_empty(F.col("idempotency_key")).isNotNull() & F.col("idempotency_key").eqNullSafe(
        F.col("original.idempotency_key")
    )
    same_event = (F.col("transaction_id") == F.col("original_id")) & (
        F.col("rail_type") == F.col("original.rail_type")
    )
    return retries.join(originals, ["tenant_bank_id", "original_id"]).filter(~shares_key & ~same_event)


def _retry_link_groups(events: DataFrame) -> DataFrame:
    """Groups of an original and its retries, in the order first retry, original, later retries."""
    settled = F.col("status") == SETTLED
    retry = F.struct("event_ordinal", "transaction_id", settled.alias("settled"))
    groups = (
        _retry_pairs(events)
        .groupBy("tenant_bank_id", "original_id")
        .agg(
            F.count(F.lit(1)).alias("retries"),
            F.count_if(settled).alias("settled_retries"),
            F.min(retry).alias("first_retry"),
            F.min(F.when(settled, retry)).alias("first_settled"),
            F.bool_or(F.col("original.status") == SETTLED).alias("original_settled"),
        )
    )
    original_settled = F.coalesce("original_settled", F.lit(False))
    reference = (
        F.when(F.coalesce(F.col("first_retry.settled"), F.lit(False)), F.col("first_retry.transaction_id"))
        .when(original_settled, F.col("original_id"))
        .otherwise(F.col("first_settled.transaction_id"))
    )
    return groups.select(
        "tenant_bank_id",
        F.concat(F.lit(RETRY_LINK), "original_id").alias("link_key"),
        (F.col("retries") + 1).alias("member_count"),
        (F.col("settled_retries") + original_settled.cast("long")).alias("settled_count"),
        reference.alias("reference_id"),
    )


def _settled_twice(groups: DataFrame) -> DataFrame:
    return groups.filter((F.col("member_count") >= 2) & (F.col("settled_count") >= 2))


def _duplicate_issues(groups: DataFrame, detected_at: dt.datetime) -> DataFrame:
    return _issue(
        _settled_twice(groups),
        DUPLICATE_PAYMENT,
        "TRANSACTION",
        detected_at,
        F.col("link_key"),
        F.struct("link_key", "settled_count", "member_count"),
        reference_id=F.col("reference_id"),
    )


def shared_key_duplicates(events: DataFrame, detected_at: dt.datetime) -> DataFrame:
    return _duplicate_issues(_shared_key_groups(events), detected_at)


def retry_link_duplicates(events: DataFrame, detected_at: dt.datetime) -> DataFrame:
    return _duplicate_issues(_retry_link_groups(events), detected_at)


def duplicate_payments(events: DataFrame, detected_at: dt.datetime) -> DataFrame:
    """Groups of payments that settled more than once."""
    groups = _shared_key_groups(events).unionByName(_retry_link_groups(events))
    return _duplicate_issues(groups, detected_at)


def duplicate_members(events: DataFrame) -> DataFrame:
    """Every event of every flagged group, one row each instead of one list per group."""
    flagged = ["tenant_bank_id", "link_key"]
    shared = events.select(
        "tenant_bank_id", F.col("idempotency_key").alias("link_key"), "transaction_id", "rail_type", "status"
    ).join(_settled_twice(_shared_key_groups(events)).select(*flagged), flagged, "left_semi")
    link = F.concat(F.lit(RETRY_LINK), "original_id").alias("link_key")
    pairs = _retry_pairs(events)
    retries = pairs.select("tenant_bank_id", link, "transaction_id", "rail_type", "status")
    originals = pairs.select(
        "tenant_bank_id",
        link,
        F.col("original_id").alias("transaction_id"),
        F.col("original.rail_type").alias("rail_type"),
        F.col("original.status").alias("status"),
    ).distinct()
    linked = retries.unionByName(originals).join(
        _settled_twice(_retry_link_groups(events)).select(*flagged), flagged, "left_semi"
    )
    settled = F.coalesce(F.col("status") == SETTLED, F.lit(False))
    return shared.unionByName(linked).select(
        *flagged, "transaction_id", "rail_type", settled.alias("is_settled")
    )


def format_rejections(events: DataFrame, detected_at: dt.datetime) -> DataFrame:
    return _issue(
        events.filter(F.col("format_validation_status") == "FAILED"),
        FORMAT_REJECTION,
        "TRANSACTION",
        detected_at,
        F.concat_ws("|", "rail_type", "transaction_id"),
        F.struct("format_validation_errors"),
        reference_id=F.col("transaction_id"),
    )


def _party_week(rows: DataFrame, issue_type: str, detected_at: dt.datetime, details: Column) -> DataFrame:
    return _issue(
        rows,
        issue_type,
        "PARTY",
        detected_at,
        F.concat_ws("|", F.col("party_id"), iso_text(F.col("window_start"))),
        details,
        reference_id=F.col("party_id"),
        window_start=F.col("window_start"),
        window_end=F.col("window_end"),
        severity_score=F.col("severity"),
    )


def format_rejection_spikes(snapshots: DataFrame, detected_at: dt.datetime) -> DataFrame:
    frame = earlier_rows(PARTY_WEEKS, "window_start")
    score = drift_score([prior_zscore(F.col("format_reject_ratio"), frame)])
    scored = merchant_weeks(snapshots).withColumn("severity", score)
    return _party_week(
        scored.filter(F.col("severity") >= REJECTION_SPIKE_SCORE),
        FORMAT_REJECTION_SPIKE,
        detected_at,
        F.struct("format_reject_ratio"),
    )


def timeout_spikes(snapshots: DataFrame, detected_at: dt.datetime) -> DataFrame:
    frame = earlier_rows(PARTY_WEEKS, "window_start")
    scored = (
        merchant_weeks(snapshots)
        .withColumn("z_score", prior_zscore(F.col("timeout_ratio"), frame))
        .withColumn("prior_weeks_used", prior_count(F.col("timeout_ratio"), frame))
        .withColumn("severity", timeout_severity(F.col("z_score")))
    )
    return _party_week(
        scored.filter(F.abs("z_score") >= TIMEOUT_FLAG_Z),
        NETWORK_TIMEOUT_SPIKE,
        detected_at,
        F.struct("timeout_ratio", "z_score", "prior_weeks_used"),
    )


def unsettled_batches(events: DataFrame, as_of: dt.datetime, detected_at: dt.datetime) -> DataFrame:
    """Batches past their first known deadline that still hold an unsettled event."""
    deadline = parse_iso(F.col("expected_settlement_at"))
    batches = (
        events.filter(F.col("batch_id").isNotNull())
        .groupBy("tenant_bank_id", "batch_id")
        .agg(
            F.min_by(deadline, F.when(deadline.isNotNull(), F.col("event_ordinal"))).alias("expected"),
            F.min_by("rail_type", "event_ordinal").alias("rail_type"),
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(~F.coalesce("file_reached_settlement", F.lit(False))).alias("unsettled_transactions"),
        )
    )
    due = F.lit(as_of).cast("timestamp")
    overdue = batches.filter((F.col("expected") <= due) & (F.col("unsettled_transactions") > 0))
    late = F.floor((F.unix_micros(due) - F.unix_micros("expected")) / 86_400_000_000)
    measured = overdue.withColumn("late_days", late).withColumn("expected_settlement_at", iso_text(F.col("expected")))
    return _issue(
        measured,
        BATCH_NOT_SETTLED,
        "BATCH",
        detected_at,
        F.col("batch_id"),
        F.struct(
            "rail_type",
            "expected_settlement_at",
            "total_transactions",
            "unsettled_transactions",
            F.col("late_days").alias("days_overdue"),
        ),
        reference_id=F.col("batch_id"),
        days_overdue=F.col("late_days"),
    )


def operational_issues(
    events: DataFrame, snapshots: DataFrame, as_of: dt.datetime, detected_at: dt.datetime
) -> DataFrame:
    """All five rules in one table."""
    parts = [
        duplicate_payments(events, detected_at),
        format_rejections(events, detected_at),
        format_rejection_spikes(snapshots, detected_at),
        unsettled_batches(events, as_of, detected_at),
        timeout_spikes(snapshots, detected_at),
    ]
    return reduce(DataFrame.unionByName, parts)
