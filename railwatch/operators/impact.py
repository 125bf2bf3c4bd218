"""What else the parties of an incident are exposed to, for every incident at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.joins import join_small
from railwatch.functions.scalars import percent_share
from railwatch.functions.skew import join_dealt
from railwatch.operators.lookup import issue_events
from railwatch.schema import FLAGGED_BANDS, FRAUD, FUNNEL, OPERATIONAL, RECONCILIATION, SPIKE_ISSUES
from railwatch.session import stored

_INCIDENT = ("signal_type", "tenant_bank_id", "reference_id")


def _incident_totals(
    issues_with_events: DataFrame, breaks_with_events: DataFrame, snapshots: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    spike = F.col("issue_type").isin(*SPIKE_ISSUES)
    variance_or_amount = F.abs(F.coalesce("variance_amount", "amount"))
    zero = F.lit(0.0)

    def incidents(rows, signal, identity, affected, value):
        return rows.select(
            F.lit(signal).alias("signal_type"),
            "tenant_bank_id",
            F.col(identity).alias("reference_id"),
            F.coalesce(affected, F.lit(0)).cast("long").alias("payments_affected"),
            F.coalesce(value, zero).alias("payment_value"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            incidents(
                issues_with_events,
                OPERATIONAL,
                "issue_id",
                F.when(~spike, F.col("event_count")),
                F.when(~spike, F.col("total_amount")),
            ),
            incidents(breaks_with_events, RECONCILIATION, "break_id", F.lit(1), variance_or_amount),
            incidents(snapshots, FRAUD, "snapshot_id", F.col("transaction_count"), F.col("amount_total")),
            incidents(beneficiaries, FUNNEL, "snapshot_id", F.col("transaction_count"), F.col("amount_total")),
        ],
    )


def _incident_parties(
    issues: DataFrame, events: DataFrame, breaks_with_events: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """Distinct parties per incident. Beneficiaries are payees and match no party."""

    def parties(rows, signal, identity, party):
        return rows.select(
            F.lit(signal).alias("signal_type"),
            "tenant_bank_id",
            F.col(identity).alias("reference_id"),
            F.col(party).alias("party_id"),
        ).filter(F.col("party_id").isNotNull())

    spikes = issues.filter(F.col("issue_type").isin(*SPIKE_ISSUES))
    others = issues.filter(~F.col("issue_type").isin(*SPIKE_ISSUES))
    return reduce(
        DataFrame.unionByName,
        [
            parties(spikes, OPERATIONAL, "issue_id", "reference_id"),
            parties(issue_events(others, events), OPERATIONAL, "issue_id", "party_id").distinct(),
            parties(breaks_with_events, RECONCILIATION, "break_id", "party_id"),
            parties(snapshots, FRAUD, "snapshot_id", "party_id"),
        ],
    )


def incident_impact(
    events: DataFrame,
    issues_with_events: DataFrame,
    breaks_with_events: DataFrame,
    snapshots: DataFrame,
    beneficiaries: DataFrame,
) -> DataFrame:
    """One row per incident with its own size and its parties' other exposure."""
    flagged = F.col("anomaly_band").isin(*FLAGGED_BANDS)
    break_value = F.abs(F.coalesce("variance_amount", "amount"))
    party = ["tenant_bank_id", "party_id"]
    party_breaks = breaks_with_events.filter(F.col("party_id").isNotNull()).groupBy(*party).agg(
        F.sum(break_value).alias("party_breaks")
    )
    party_fraud = snapshots.filter(flagged).groupBy(*party).agg(F.sum("amount_total").alias("party_fraud"))

    involved = stored(_incident_parties(issues_with_events, events, breaks_with_events, snapshots), "involved")
    exposed = party_breaks.join(party_fraud, party, "full_outer")
    other = (
        join_dealt(involved, exposed, party)
        .groupBy(*_INCIDENT)
        .agg(
            F.coalesce(F.sum("party_breaks"), F.lit(0.0)).alias("reconciliation_exposure"),
            F.coalesce(F.sum("party_fraud"), F.lit(0.0)).alias("party_fraud"),
        )
    )
    own_fraud = snapshots.filter(flagged).select(
        F.lit(FRAUD).alias("signal_type"),
        "tenant_bank_id",
        F.col("snapshot_id").alias("reference_id"),
        F.coalesce("amount_total", F.lit(0.0)).alias("own_flagged"),
    )
    totals = (
        events.groupBy("tenant_bank_id")
        .agg(F.count(F.lit(1)).alias("all_transactions"), F.sum("amount").alias("all_amount"))
        .join(breaks_with_events.groupBy("tenant_bank_id").agg(F.sum(break_value).alias("all_breaks")), "tenant_bank_id", "left")
        .join(snapshots.filter(flagged).groupBy("tenant_bank_id").agg(F.sum("amount_total").alias("all_fraud")), "tenant_bank_id", "left")
    )
    sized = (
        _incident_totals(issues_with_events, breaks_with_events, snapshots, beneficiaries)
        .join(other, list(_INCIDENT), "left")
        .join(own_fraud, list(_INCIDENT), "left")
    )
    sized = (
        join_small(sized, totals, ["tenant_bank_id"], "left")
        .fillna(0.0, ["reconciliation_exposure", "party_fraud", "own_flagged", "all_amount", "all_breaks", "all_fraud"])
    )
    own = F.when(F.col("signal_type") == FRAUD, F.col("payment_value")).otherwise(0.0)
    fraud = own + F.col("party_fraud") - F.col("own_flagged")
    return sized.select(
        *_INCIDENT,
        "payments_affected",
        percent_share(F.col("payments_affected"), F.col("all_transactions")).alias("payments_affected_percent"),
        F.bround("payment_value", 2).alias("payment_value"),
        percent_share(F.col("payment_value"), F.col("all_amount")).alias("payment_value_percent"),
        F.bround("reconciliation_exposure", 2).alias("reconciliation_exposure"),
        percent_share(F.col("reconciliation_exposure"), F.col("all_breaks")).alias("reconciliation_exposure_percent"),
        F.bround(fraud, 2).alias("fraud_exposure"),
        percent_share(fraud, F.col("all_fraud")).alias("fraud_exposure_percent"),
    )
