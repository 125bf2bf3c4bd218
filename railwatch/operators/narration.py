"""Facts for narrated findings, checks on returned texts, and their cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railwatch.functions.scalars import iso_text
from railwatch.schema import CASE, FLAGGED_BANDS, FRAUD, FUNNEL, FUNNEL_THRESHOLD, OPERATIONAL, RECONCILIATION

NARRATIVE_KEY = ("signal_type", "tenant_bank_id", "reference_id")
_ACTION = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "why")])
_NARRATIVE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("recommended_actions", T.ArrayType(_ACTION)),
    ]
)


def _facts(rows: DataFrame, signal: str, reference: str, identifier: str, *fields: str | Column) -> DataFrame:
    columns = [F.col(f) if isinstance(f, str) else f for f in fields]
    document = F.to_json(F.struct(F.lit(signal).alias("signal_type"), *columns))
    return rows.select(
        F.lit(signal).alias("signal_type"),
        "tenant_bank_id",
        F.col(reference).alias("reference_id"),
        F.col(identifier).alias("identifier"),
        document.alias("facts"),
    )


def _time(column: str) -> Column:
    return iso_text(F.col(column)).alias(column)


def finding_facts(
    issues: DataFrame, breaks: DataFrame, snapshots: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    """One fact document per issue, break, flagged snapshot and funnel."""
    flagged = snapshots.filter(F.col("anomaly_band").isin(*FLAGGED_BANDS))
    funnels = beneficiaries.filter(F.col("funnel_drift_score") >= FUNNEL_THRESHOLD)
    parts = [
        _facts(
            issues, OPERATIONAL, "issue_id", "reference_id",
            "issue_type", "reference_type", "reference_id", "severity_score", "details", _time("detected_at"),
        ),
        _facts(
            breaks, RECONCILIATION, "break_id", "transaction_id",
            "detection_type", "transaction_id", "rail_type", "source_reconciliation_status", "variance_amount",
            "amount", _time("detected_at"),
        ),
        _facts(
            flagged, FRAUD, "snapshot_id", "party_id",
            "party_id", "party_type", _time("window_start"), _time("window_end"), "transaction_count", "amount_total",
            "isolation_forest_score", "cluster_changed", "timeseries_drift_score", "final_anomaly_score", "anomaly_band",
        ),
        _facts(
            funnels, FUNNEL, "snapshot_id", "beneficiary_key",
            "beneficiary_key", "beneficiary_name", _time("window_start"), _time("window_end"), "transaction_count",
            "amount_total", "distinct_senders", "distinct_new_senders", "new_sender_ratio", "sender_party_types",
            "funnel_drift_score",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def case_facts(cases: DataFrame, trends: DataFrame) -> DataFrame:
    """One fact document per case with the weekly trend of its category and rail.

    The alerts of a case are documents of their own (:func:`case_alert_facts`),
    since a case may hold any number of them.
    """
    trend = trends.select(
        F.col("tenant_bank_id").alias("__tenant"),
        F.col("category").alias("__category"),
        F.col("payment_rail").alias("__rail"),
        F.struct("weeks_observed", "latest_week_count", "prior_weeks_average_count", "direction").alias("category_trend"),
    )
    same_pair = (
        (F.col("tenant_bank_id") == F.col("__tenant"))
        & (F.col("category") == F.col("__category"))
        & F.col("payment_rail").eqNullSafe(F.col("__rail"))
    )
    return _facts(
        cases.join(trend, same_pair, "left"),
        CASE,
        "case_code",
        "case_code",
        "case_code",
        "category",
        "payment_rail",
        "current_exposure",
        "transactions_affected",
        "contributing_alerts_count",
        _time("opened_at"),
        "category_trend",
    )


def case_alert_facts(alerts: DataFrame) -> DataFrame:
    return _facts(
        alerts, CASE, "case_code", "alert_code", "anomaly_type", "anomaly_category", "payment_rail", _time("detected_at")
    )


def validated(returned: DataFrame, facts: DataFrame) -> DataFrame:
    """Returned texts parsed and checked; ``problem`` is null where all checks pass.

    A text needs a title, a description and one to three complete actions, and
    must name the finding's identifier exactly.
    """
    parsed = returned.join(facts.select(*NARRATIVE_KEY, "identifier"), list(NARRATIVE_KEY), "left").withColumn(
        "parsed", F.from_json("content", _NARRATIVE)
    )
    narrative = F.col("parsed")
    actions = narrative["recommended_actions"]
    complete = F.forall(
        actions,
        lambda a: a["title"].isNotNull() & a["description"].isNotNull() & a["why"].isNotNull(),
    )
    missing = (
        narrative.isNull()
        | narrative["title"].isNull()
        | narrative["description"].isNull()
        | actions.isNull()
    )
    text = F.concat_ws(" ", narrative["title"], narrative["description"])
    named = F.col("identifier").isNull() | (F.col("identifier") == "") | F.contains(text, F.col("identifier"))
    problem = (
        F.when(missing, "missing required keys")
        .when(~F.size(actions).between(1, 3), "needs one to three actions")
        .when(~complete, "incomplete action")
        .when(~named, "identifier not named")
    )
    return parsed.withColumn("problem", problem)


def narrative_rows(checked: DataFrame, model: str) -> DataFrame:
    """Cache rows of the texts that passed; the first action is the primary one."""
    narrative = F.col("parsed")
    first = F.try_element_at(narrative["recommended_actions"], F.lit(1))
    return checked.filter(F.col("problem").isNull()).select(
        *NARRATIVE_KEY,
        narrative["title"].alias("title"),
        narrative["description"].alias("description"),
        first["title"].alias("recommended_action_title"),
        first["description"].alias("recommended_action_description"),
        narrative["recommended_actions"].alias("recommended_actions"),
        F.lit(model).alias("model"),
        "generated_at",
    )


def uncached(facts: DataFrame, narratives: DataFrame, force: bool = False) -> DataFrame:
    """Facts that still need a text; all of them where forced."""
    if force:
        return facts
    return facts.join(narratives.select(*NARRATIVE_KEY), list(NARRATIVE_KEY), "left_anti")


def without_case_narratives(narratives: DataFrame, tenant: str | None = None) -> DataFrame:
    """What stays cached when the cases of a scope are rebuilt."""
    stale = F.col("signal_type") == CASE
    if tenant is not None:
        stale = stale & (F.col("tenant_bank_id") == tenant)
    return narratives.filter(~stale)


def list_narratives(narratives: DataFrame, tenant: str) -> DataFrame:
    own = narratives.filter(F.col("tenant_bank_id") == tenant)
    return own.orderBy(F.desc("generated_at"), "signal_type", "reference_id")
