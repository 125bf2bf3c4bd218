"""Events behind findings, by transaction and by batch.

Each lookup is combined to one row per key before it is joined, so a
transaction id or batch that many events share never multiplies findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.joins import join_small
from railwatch.functions.scalars import parse_iso
from railwatch.functions.skew import join_dealt
from railwatch.operators.parties import party_id
from railwatch.schema import BATCH_NOT_SETTLED


# The event column that each kind of reference names.
_KEYS = {"TRANSACTION": "transaction_id", "BATCH": "batch_id"}


def _of_type(issues: DataFrame, reference_type: str, *columns: str) -> DataFrame:
    key = F.col("reference_id").alias(_KEYS[reference_type])
    return issues.filter(F.col("reference_type") == reference_type).select("tenant_bank_id", key, *columns)


def _first_and_totals(events: DataFrame, issues: DataFrame, reference_type: str) -> DataFrame:
    """First event, amount total and event count of each id that some issue names."""
    key = _KEYS[reference_type]
    slim = events.filter(F.col(key).isNotNull()).select(
        *dict.fromkeys(("tenant_bank_id", key, "transaction_id", "rail_type", "amount", "event_ordinal")),
        parse_iso(F.col("transaction_occurred_at")).alias("occurred_ts"),
    )
    named = join_small(slim, _of_type(issues, reference_type).distinct(), ["tenant_bank_id", key], "left_semi")
    first = F.struct("rail_type", "amount", "transaction_id", "occurred_ts")
    found = named.groupBy("tenant_bank_id", F.col(key).alias("reference_id")).agg(
        F.min_by(first, "event_ordinal").alias("first_event"),
        F.coalesce(F.sum(F.abs("amount")), F.lit(0.0)).alias("total_amount"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return found.withColumn("reference_type", F.lit(reference_type))


def with_events(issues: DataFrame, events: DataFrame) -> DataFrame:
    """Add the first event, amount total and event count behind each issue.

    Only events that some issue names are grouped. Party-level issues match
    nothing and keep nulls. The occurrence time is the issue's own window end
    where it has one.
    """
    references = _first_and_totals(events, issues, "TRANSACTION").unionByName(_first_and_totals(events, issues, "BATCH"))
    joined = issues.join(references, ["tenant_bank_id", "reference_type", "reference_id"], "left")
    return joined.withColumn("occurred_ts", F.coalesce("window_end", "first_event.occurred_ts"))


def issue_events(issues: DataFrame, events: DataFrame) -> DataFrame:
    """One row per issue and matching event, with the event's key and party."""
    slim = events.select("tenant_bank_id", "rail_type", "transaction_id", "batch_id", party_id().alias("party_id"), "event_ordinal")

    def matches(reference_type: str) -> DataFrame:
        key = _KEYS[reference_type]
        named = _of_type(issues, reference_type, "issue_id", "issue_type", "reference_type")
        held = slim.filter(F.col(key).isNotNull())
        held = join_small(held, named.select("tenant_bank_id", key).distinct(), ["tenant_bank_id", key], "left_semi")
        found = join_dealt(held, named, ["tenant_bank_id", key])
        return found.withColumn("reference_id", F.col(key)).drop("batch_id")

    return matches("TRANSACTION").unionByName(matches("BATCH"))


def is_batch_issue():
    return F.col("issue_type") == BATCH_NOT_SETTLED
