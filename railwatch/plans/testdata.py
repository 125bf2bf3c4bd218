"""Canonical payment events derived from the ``events`` table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railwatch.functions.scalars import labelled
from railwatch.schema import CONFIRMED, DISMISSED
from railwatch.session import input_state, prepare, spread

AS_OF = dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)
DETECTED_AT = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)

# The rail each event type stands for, and its response-map prefix.
RAIL_OF_TYPE = {"click": "ACH", "view": "WIRE", "purchase": "CARD", "signup": "FEDNOW", "error": "CHEQUE"}



def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _with_parts(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.pmod(F.expr("user_id div 3"), F.lit(5)).alias("cohort"),
    )


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = input_state(spark, f"{sf_dir}/events.parquet").size
    e = _with_parts(spread(raw_events(spark, sf_dir), size))
    k, event_id, user = F.col("k"), F.col("event_id"), F.col("user_id").cast("string")
    merchant, individual = F.col("cohort") < 3, F.col("cohort") >= 3
    retry = (k % 20) == 3
    payee_number = (event_id * 7 + k) % 40
    occurred = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rail = labelled(RAIL_OF_TYPE, F.col("event_type"))
    prefix = F.when(rail == "CHEQUE", "clearing_network_response").otherwise("network_response_control")
    reconciliation = (
        F.when(k % 4 == 0, None).when(k % 11 == 0, "BREAK").when(k % 7 == 0, "NOT_YET_RECONCILED").otherwise("MATCHED")
    )
    variance = (
        F.when(k % 4 == 0, None)
        .when(k % 11 == 0, F.when(k % 2 == 0, 0).otherwise(k - 50))
        .when(k % 7 == 0, F.when(k % 3 == 0, k).otherwise(0))
        .otherwise(0)
    ).cast("double")
    flag = F.when(k % 9 == 0, None).otherwise(k % 5 == 0)
    text = F.lit(None).cast("string")
    flags = F.lit(None).cast("map<string,string>")

    def party(condition: Column, prefix: str) -> Column:
        return F.when(condition, F.concat(F.lit(prefix), user))

    columns = {
        "tenant_bank_id": F.concat(F.lit("BANK_"), (F.col("user_id") % 3).cast("string")),
        "rail_type": rail,
        "transaction_id": F.concat(F.lit("TXN-"), event_id.cast("string")),
        "event_ordinal": event_id,
        "payer_name": F.when(k % 3 != 0, F.concat(F.lit("PARTY-"), user)),
        "payer_account_ref": text,
        "payee_name": F.concat(F.lit("PAYEE-"), payee_number.cast("string")),
        "payee_account_ref": F.when(k % 2 != 0, F.concat(F.lit("****"), F.lpad(payee_number.cast("string"), 4, "0"))),
        "amount": F.col("value") * 100,
        "transaction_occurred_at": occurred,
        "status": F.when(k % 10 < 7, "SETTLED").when(k % 10 == 7, "FAILED").when(k % 10 == 8, "PENDING"),
        "risk_flags": flags,
        "source_merchant_id": party(merchant, "M"),
        "source_individual_id": party(individual | (k % 25 == 0), "I"),
        "merchant_id": party(merchant, "MER-"),
        "individual_id": party(individual, "IND-"),
        "processor_name": text,
        "onboarded_by": text,
        "is_retry": retry,
        "original_transaction_id": F.when(retry, F.concat(F.lit("TXN-"), (event_id - 1).cast("string"))),
        "idempotency_key": F.when(
            ~(retry & (k >= 60)),
            F.concat(F.lit("IDEM-"), F.when(retry, event_id - 1).otherwise(event_id).cast("string")),
        ),
        "format_validation_status": F.when(k % 29 == 0, None).when(k % 13 == 0, "FAILED").otherwise("PASSED"),
        "format_validation_errors": flags,
        "reconciliation_status": reconciliation,
        "reconciliation_variance_amount": variance,
        "reconciliation_details": flags,
        "network_response_details": F.create_map(
            F.concat(prefix, F.lit(".response_time_ms")),
            (100 + 10 * k).cast("string"),
            F.concat(prefix, F.lit(".expected_response_sla_ms")),
            F.lit("900"),
        ),
        "network_timeout_flag": k > 80,
        "batch_id": F.concat_ws(
            "-", F.lit("BATCH"), "event_type", F.date_format("ts", "yyyyMMdd"), (F.col("user_id") % 3).cast("string")
        ),
        "expected_settlement_at": F.concat(
            F.date_format(F.date_add(F.to_date("ts"), 2), "yyyy-MM-dd"), F.lit("T00:00:00Z")
        ),
        "file_reached_settlement": k >= 2,
        "new_payee_risk_flag": flag,
        "funnel_account_flag": flag,
        "velocity_threshold_breached": flag,
        "structuring_flag": flag,
        "first_seen_at": F.date_trunc("second", F.col("ts")).cast("timestamp"),
        "last_updated_at": F.date_trunc("second", F.col("ts")).cast("timestamp"),
    }
    return e.select(*(column.alias(name) for name, column in columns.items()))


def _digit(text: Column, position: int) -> Column:
    return F.ascii(F.substring(F.md5(text), position, 1))


def derived_reviews(claims: DataFrame) -> DataFrame:
    """A review for two of three claims, chosen and timed by a digest of the claim."""
    reference = F.col("reference_id")
    choice = _digit(reference, 1) % 3
    seconds = (
        (_digit(reference, 2) % 10).cast("long") * 86400 + _digit(reference, 3) * 60 + _digit(reference, 4)
    )
    reviewed = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-02-01 00:00:00")) + seconds)
    return claims.filter(choice < 2).select(
        "signal_type",
        "tenant_bank_id",
        "reference_id",
        F.when(choice == 0, CONFIRMED).otherwise(DISMISSED).alias("status"),
        reviewed.alias("reviewed_at"),
    )
