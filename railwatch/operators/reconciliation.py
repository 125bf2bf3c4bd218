"""Confirmed breaks and provisional variances."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.scalars import parse_iso
from railwatch.operators.parties import party_id
from railwatch.schema import CONFIRMED_BREAK, PROVISIONAL_VARIANCE


def reconciliation_breaks(events: DataFrame, detected_at: dt.datetime) -> DataFrame:
    """Breaks with the time and party of the event they are found in."""
    variance = F.col("reconciliation_variance_amount")
    detection = F.when(F.col("reconciliation_status") == "BREAK", CONFIRMED_BREAK).when(
        variance != 0.0, PROVISIONAL_VARIANCE
    )
    return (
        events.filter(F.col("reconciliation_status").isNotNull())
        .withColumn("detection_type", detection)
        .filter(F.col("detection_type").isNotNull())
        .select(
            F.concat_ws("|", "tenant_bank_id", "rail_type", "transaction_id").alias("break_id"),
            "tenant_bank_id",
            "transaction_id",
            "rail_type",
            "detection_type",
            F.col("reconciliation_status").alias("source_reconciliation_status"),
            variance.alias("variance_amount"),
            "amount",
            F.to_json("reconciliation_details").alias("details"),
            parse_iso(F.col("transaction_occurred_at")).alias("occurred_ts"),
            party_id().alias("party_id"),
            F.lit(detected_at).cast("timestamp").alias("detected_at"),
        )
    )
