"""Ageing of open cases against the window of their priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Days allowed per priority, and the remaining share that counts as close.
SLA_DAYS = {"Critical": 2.0, "High": 5.0, "Medium": 10.0, "Low": 20.0}
DEFAULT_DAYS = 10.0
APPROACHING_SHARE = 0.3


def cases_near_sla(anchored_cases: DataFrame) -> DataFrame:
    """Pending cases that are overdue or in the last part of their window, most urgent first.

    Age is measured up to the latest anchor of the tenant's pending cases.
    """
    pending = anchored_cases.filter(F.col("validation_status") == "PENDING")
    now = pending.groupBy("tenant_bank_id").agg(F.max("anchor_ts").alias("now_ts"))
    allowed = F.lit(DEFAULT_DAYS)
    for level, days in SLA_DAYS.items():
        allowed = F.when(F.col("priority_level") == level, F.lit(days)).otherwise(allowed)
    age = (F.unix_micros("now_ts") - F.unix_micros("anchor_ts")) / 86_400_000_000
    aged = (
        pending.join(now, "tenant_bank_id")
        .withColumn("sla_window_days", allowed)
        .withColumn("age", age)
        .withColumn("remaining", F.col("sla_window_days") - F.col("age"))
        .filter(F.col("remaining") <= F.col("sla_window_days") * APPROACHING_SHARE)
    )
    return aged.select(
        "tenant_bank_id",
        "case_code",
        "title",
        "priority_level",
        "current_exposure",
        "sla_window_days",
        F.bround("age", 1).alias("age_days"),
        F.bround("remaining", 1).alias("remaining_days"),
        F.when(F.col("remaining") <= 0, "overdue").otherwise("approaching").alias("status"),
    ).orderBy("tenant_bank_id", "remaining_days", "case_code")
