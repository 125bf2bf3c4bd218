"""Severity of findings relative to their peers in the same tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.functions.scalars import priority_level
from railwatch.operators.lookup import with_events
from railwatch.schema import BATCH_NOT_SETTLED, CONFIRMED_BREAK, SPIKE_ISSUES, TRANSACTION_ISSUES

MIDDLE_SCORE = 50.0
CONFIRMED_FLOOR = 50.0


def with_issue_priority(issues: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``priority_score`` and ``priority_level`` to issues joined to their events.

    Spikes keep their own score. Transaction issues are ranked by amount and
    batches by days overdue, each within tenant and issue type.
    """
    return rank_issues(with_events(issues, events))


def rank_issues(found: DataFrame) -> DataFrame:
    size = F.when(F.col("issue_type").isin(*TRANSACTION_ISSUES), F.abs("first_event.amount")).when(
        F.col("issue_type") == BATCH_NOT_SETTLED, F.col("days_overdue").cast("double")
    )
    ranked = ranks.percent_at_or_below(
        found.withColumn("peer_size", size), ["tenant_bank_id", "issue_type"], "peer_size", "peer_rank"
    )
    own = F.when(F.col("issue_type").isin(*SPIKE_ISSUES), F.col("severity_score"))
    score = F.coalesce(own, F.col("peer_rank"), F.lit(MIDDLE_SCORE))
    return (
        ranked.withColumn("priority_level", priority_level(score))
        .withColumn("priority_score", F.bround(score, 1))
        .drop("peer_rank", "peer_size")
    )


def with_break_priority(breaks: DataFrame) -> DataFrame:
    """Rank breaks by variance, or by amount where there is none or it is zero."""
    variance = F.col("variance_amount")
    size = F.abs(F.when(variance != 0.0, variance).otherwise(F.col("amount")))
    ranked = ranks.percent_at_or_below(breaks.withColumn("peer_size", size), ["tenant_bank_id"], "peer_size", "peer_rank")
    score = F.coalesce("peer_rank", F.lit(MIDDLE_SCORE))
    floored = F.when(F.col("detection_type") == CONFIRMED_BREAK, F.greatest(score, F.lit(CONFIRMED_FLOOR))).otherwise(score)
    return (
        ranked.withColumn("priority_level", priority_level(floored))
        .withColumn("priority_score", F.bround(floored, 1))
        .drop("peer_rank", "peer_size")
    )
