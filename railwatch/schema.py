"""The canonical event layout and the fixed vocabulary of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING = T.StringType()
_DOUBLE = T.DoubleType()
_BOOLEAN = T.BooleanType()
_MAP = T.MapType(T.StringType(), T.StringType())

EVENT_KEY = ("tenant_bank_id", "rail_type", "transaction_id")

# Fields a mapping may fill, with the type each value is coerced to.
MAPPED_FIELDS: dict[str, T.DataType] = {
    "payer_name": _STRING,
    "payer_account_ref": _STRING,
    "payee_name": _STRING,
    "payee_account_ref": _STRING,
    "amount": _DOUBLE,
    "currency": _STRING,
    "fees": _DOUBLE,
    "transaction_occurred_at": _STRING,
    "status": _STRING,
    "risk_flags": _MAP,
    "source_merchant_id": _STRING,
    "merchant_id": _STRING,
    "source_individual_id": _STRING,
    "individual_id": _STRING,
    "processor_name": _STRING,
    "onboarded_by": _STRING,
    "counterparty_bank_name": _STRING,
    "new_payee_risk_flag": _BOOLEAN,
    "funnel_account_flag": _BOOLEAN,
    "velocity_threshold_breached": _BOOLEAN,
    "structuring_flag": _BOOLEAN,
    "fraud_risk_details": _MAP,
    "network_timeout_flag": _BOOLEAN,
    "network_response_details": _MAP,
    "batch_id": _STRING,
    "file_reached_settlement": _BOOLEAN,
    "expected_settlement_at": _STRING,
    "batch_tracking_details": _MAP,
    "is_retry": _BOOLEAN,
    "original_transaction_id": _STRING,
    "idempotency_key": _STRING,
    "duplicate_check_status": _STRING,
    "retry_details": _MAP,
    "format_validation_status": _STRING,
    "format_validation_errors": _MAP,
    "reconciliation_status": _STRING,
    "reconciliation_variance_amount": _DOUBLE,
    "reconciliation_details": _MAP,
}

# Rails, settlement stages, statuses and label texts.
RAILS = ("ACH", "CARD", "CHEQUE", "FEDNOW", "WIRE")
SETTLED = "SETTLED"
MERCHANT = "MERCHANT"
INDIVIDUAL = "INDIVIDUAL"
WEEKLY = "WEEKLY"
TO_DATE = "TO_DATE"

DUPLICATE_PAYMENT = "DUPLICATE_PAYMENT"
FORMAT_REJECTION = "FORMAT_REJECTION"
FORMAT_REJECTION_SPIKE = "FORMAT_REJECTION_SPIKE"
BATCH_NOT_SETTLED = "BATCH_NOT_SETTLED"
NETWORK_TIMEOUT_SPIKE = "NETWORK_TIMEOUT_SPIKE"
TRANSACTION_ISSUES = (DUPLICATE_PAYMENT, FORMAT_REJECTION)
SPIKE_ISSUES = (NETWORK_TIMEOUT_SPIKE, FORMAT_REJECTION_SPIKE)

CONFIRMED_BREAK = "CONFIRMED_BREAK"
PROVISIONAL_VARIANCE = "PROVISIONAL_VARIANCE"

PENDING = "PENDING"
CONFIRMED = "CONFIRMED"
DISMISSED = "DISMISSED"

FLAGGED_BANDS = ("High", "Critical")
FUNNEL_THRESHOLD = 50.0

OPERATIONAL = "operational_issue"
RECONCILIATION = "reconciliation_break"
FRAUD = "fraud_anomaly"
FUNNEL = "funnel_account"
CASE = "investigation_case"

CATEGORY_LABELS = {
    NETWORK_TIMEOUT_SPIKE: "Failure-rate spike",
    BATCH_NOT_SETTLED: "Batch never settles",
    DUPLICATE_PAYMENT: "Duplicate payment",
    FORMAT_REJECTION: "Formatting rejection",
    FORMAT_REJECTION_SPIKE: "Formatting rejection spike",
    CONFIRMED_BREAK: "Confirmed reconciliation break",
    PROVISIONAL_VARIANCE: "Provisional reconciliation variance",
}
