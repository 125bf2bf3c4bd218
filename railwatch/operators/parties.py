"""The resolved party behind each event, and the per-party roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railwatch.functions.scalars import non_empty
from railwatch.schema import INDIVIDUAL, MERCHANT

PARTY_KEY = ("tenant_bank_id", "party_type", "party_id")

# Output column -> flag whose true share among its non-null rows is reported.
_FLAG_RATES = {
    "new_payee_risk_rate": "new_payee_risk_flag",
    "funnel_account_rate": "funnel_account_flag",
    "velocity_breach_rate": "velocity_threshold_breached",
    "structuring_rate": "structuring_flag",
    "network_timeout_rate": "network_timeout_flag",
    "is_retry_rate": "is_retry",
}
# Output column -> (status column, the status that counts as bad).
_BAD_STATUS_RATES = {
    "format_reject_rate": ("format_validation_status", "FAILED"),
    "reconciliation_break_rate": ("reconciliation_status", "BREAK"),
}


def party_id() -> Column:
    return F.coalesce(non_empty(F.col("merchant_id")), non_empty(F.col("individual_id")))


def party_type() -> Column:
    return F.when(non_empty(F.col("merchant_id")).isNotNull(), MERCHANT).when(
        non_empty(F.col("individual_id")).isNotNull(), INDIVIDUAL
    )


def with_party(events: DataFrame) -> DataFrame:
    return events.withColumn("party_id", party_id()).withColumn("party_type", party_type())


def share_true(flag: Column) -> Column:
    """Share of true among the non-null values; null where there are none."""
    return F.avg(flag.cast("double"))


def share_status(status: Column, bad: str) -> Column:
    return F.avg((status == bad).cast("double"))


def party_features(events: DataFrame) -> DataFrame:
    """One row per resolved party: volumes, rails, counterparties and flag rates.

    Rails are gathered apart from the distinct count, which would otherwise
    carry one set of rails per counterparty.
    """
    resolved = with_party(events).filter(F.col("party_id").isNotNull())
    measures = resolved.groupBy(*PARTY_KEY).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        _count_or_null("payee_name").alias("distinct_counterparties"),
        *(share_true(F.col(flag)).alias(name) for name, flag in _FLAG_RATES.items()),
        *(share_status(F.col(column), bad).alias(name) for name, (column, bad) in _BAD_STATUS_RATES.items()),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_updated_at").alias("last_seen_at"),
    )
    rails = resolved.groupBy(*PARTY_KEY).agg(F.array_sort(F.collect_set("rail_type")).alias("rails_active"))
    return measures.join(rails, list(PARTY_KEY))


def _count_or_null(column: str) -> Column:
    distinct = F.count_distinct(non_empty(F.col(column)))
    return F.when(distinct > 0, distinct)
