"""Drift of merchants and beneficiaries against their own earlier weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.history import drift_score, earlier_rows, prior_zscore
from railwatch.schema import MERCHANT, WEEKLY

MERCHANT_FEATURES = ("amount_total", "transaction_count", "new_counterparty_ratio")
FUNNEL_FEATURES = ("distinct_senders", "new_sender_ratio")
PARTY_WEEKS = ("tenant_bank_id", "party_id")
BENEFICIARY_WEEKS = ("tenant_bank_id", "beneficiary_key")


def merchant_weeks(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter((F.col("party_type") == MERCHANT) & (F.col("window_type") == WEEKLY))


def with_merchant_drift(snapshots: DataFrame) -> DataFrame:
    """Add ``timeseries_drift_score``; null on to-date rows and on the first two weeks.

    To-date rows have one row per party, so they share the window harmlessly.
    """
    frame = earlier_rows((*PARTY_WEEKS, "window_type"), "window_start")
    score = drift_score([prior_zscore(F.col(c), frame) for c in MERCHANT_FEATURES])
    weekly = (F.col("party_type") == MERCHANT) & (F.col("window_type") == WEEKLY)
    return snapshots.withColumn("timeseries_drift_score", F.when(weekly, score))


def with_funnel_drift(beneficiaries: DataFrame) -> DataFrame:
    frame = earlier_rows(BENEFICIARY_WEEKS, "window_start")
    score = drift_score([prior_zscore(F.col(c), frame) for c in FUNNEL_FEATURES])
    return beneficiaries.withColumn("funnel_drift_score", score)
