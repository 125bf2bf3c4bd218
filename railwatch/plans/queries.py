"""Registered queries: each a job over a data folder, with its SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railwatch.functions.scalars import account_type, iso_text, map_value_by_suffix, masked_last4, normalized_status, parse_iso, to_boolean
from railwatch.operators import (
    cases,
    dashboards,
    density,
    exposure,
    forest,
    health,
    identity,
    impact,
    listings,
    narration,
    operations,
    parties,
    review,
    scoring,
    sla,
    snapshots,
    trends,
    vectors,
)
from railwatch.operators.lookup import is_batch_issue, issue_events
from railwatch.plans.oracles import _BAND, _LABEL, statement
from railwatch.plans.testdata import AS_OF, DETECTED_AT
from railwatch.plans.workbench import ScoredRun, Workbench
from railwatch.schema import MAPPED_FIELDS
from railwatch.session import InputState, input_state
from railwatch.sources import layouts, mapping, merge
from railwatch.sources.files import POSITION

START, END = dt.date(2024, 1, 8), dt.date(2024, 1, 14)


class Query(NamedTuple):
    job: Callable[[Workbench], DataFrame]
    sql: str | None


_REGISTRY: dict[str, Query] = {}
_BENCHES: dict[tuple[SparkSession, str], tuple[InputState, Workbench]] = {}


def workbench(spark: SparkSession, sf_dir: str) -> Workbench:
    """One set of stage tables per session and state of a folder, as a nightly run would build them."""
    key, state = (spark, sf_dir), input_state(spark, f"{sf_dir}/events.parquet")
    if key not in _BENCHES or _BENCHES[key][0] != state:
        _BENCHES[key] = (state, Workbench(spark, sf_dir))
    return _BENCHES[key][1]


def forget() -> None:
    """Drop the stage tables, so that the next query builds its own."""
    _BENCHES.clear()


def present(df: DataFrame) -> DataFrame:
    """Round doubles, and turn times, dates and arrays into texts."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = iso_text(column)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.concat_ws(",", column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(sql: str | None = None, **replaced: str):
    """Register a job under its function name, with the final select that states its result."""

    def register(job: Callable[[Workbench], DataFrame]):
        _REGISTRY[job.__name__] = Query(job, statement(sql, **replaced) if sql else None)
        return job

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(job):
        return lambda spark, sf_dir: present(job(workbench(spark, sf_dir)))

    return {name: bound(entry.job) for name, entry in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in _REGISTRY.items() if entry.sql}


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _iso(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%dT%H:%M:%SZ') AS {n}" for n in names)


# --- events and parties -------------------------------------------------------


@query(
    f"""SELECT tenant_bank_id, party_type, party_id, transaction_count, round(amount, 6) AS total_amount, round(mean, 6) AS avg_amount,
 rails_active, distinct_counterparties, {_r('new_payee_risk_rate', 'funnel_account_rate', 'velocity_breach_rate', 'structuring_rate', 'network_timeout_rate', 'is_retry_rate', 'format_reject_rate', 'reconciliation_break_rate')},
 {_iso('first_seen_at', 'last_seen_at')} FROM (SELECT tenant_bank_id, party_type, party_id, count(*) AS transaction_count, sum(amount) AS amount, avg(amount) AS mean,
 array_to_string(list_sort(list(DISTINCT rail_type)), ',') AS rails_active, count(DISTINCT payee_name) AS distinct_counterparties,
 avg(fraud_flag::INT) AS new_payee_risk_rate, avg(fraud_flag::INT) AS funnel_account_rate, avg(fraud_flag::INT) AS velocity_breach_rate, avg(fraud_flag::INT) AS structuring_rate,
 avg(network_timeout_flag::INT) AS network_timeout_rate, avg(is_retry::INT) AS is_retry_rate, avg((format_validation_status = 'FAILED')::INT) AS format_reject_rate,
 avg((reconciliation_status = 'BREAK')::INT) AS reconciliation_break_rate, min(ots) AS first_seen_at, max(ots) AS last_seen_at FROM ev GROUP BY ALL)"""
)
def party_features(w: Workbench) -> DataFrame:
    return parties.party_features(w.events)


@query("SELECT tenant_bank_id, coalesce(status, 'UNKNOWN') AS status, count(*) AS transaction_count FROM ev GROUP BY ALL")
def status_breakdown(w: Workbench) -> DataFrame:
    return dashboards.status_breakdown(w.events)


_RAILS = """SELECT e.tenant_bank_id, e.rail_type, transaction_count, settled_count, round(total_amount, 6) AS total_amount,
 coalesce(b.n, 0) AS reconciliation_break_count, round(settled_count / transaction_count, 6) AS settlement_rate
 FROM (SELECT tenant_bank_id, rail_type, count(*) AS transaction_count, count(*) FILTER (status = 'SETTLED') AS settled_count, sum(amount) AS total_amount FROM ev {0} GROUP BY ALL) e
 LEFT JOIN (SELECT tenant_bank_id, rail_type, count(*) AS n FROM brk {1} GROUP BY ALL) b USING (tenant_bank_id, rail_type)"""
_EVENT_WINDOW = "WHERE transaction_occurred_at >= '2024-01-08' AND transaction_occurred_at < '2024-01-15'"
_TIME_WINDOW = "WHERE occurred_ts >= TIMESTAMP '2024-01-08' AND occurred_ts < TIMESTAMP '2024-01-15'"
_END_WINDOW = "WHERE window_end >= TIMESTAMP '2024-01-08' AND window_end < TIMESTAMP '2024-01-15'"


@query(_RAILS.format("", ""))
def rail_stats(w: Workbench) -> DataFrame:
    return dashboards.rail_stats(w.events, w.found_breaks)


@query(_RAILS.format(_EVENT_WINDOW, _TIME_WINDOW))
def rail_stats_in_window(w: Workbench) -> DataFrame:
    return dashboards.rail_stats(w.events, w.found_breaks, START, END)


# --- ingestion ----------------------------------------------------------------


@query(
    """SELECT transaction_id, CASE WHEN k % 4 = 0 THEN 'SETTLED' WHEN k % 4 = 1 THEN 'PENDING' WHEN k % 4 = 2 THEN 'FAILED' ELSE 'ON_HOLD' END AS status,
 '****' || right(user_id::VARCHAR || lpad(k::VARCHAR, 3, '0'), 4) AS account_ref FROM ev"""
)
def normalize_and_mask(w: Workbench) -> DataFrame:
    number = F.split("transaction_id", "-")[1].cast("long")
    k = _k(w.events)
    spelled = F.when(k % 4 == 0, " complete ").when(k % 4 == 1, "in progress").when(k % 4 == 2, "Declined").otherwise("on hold")
    user = F.regexp_extract(F.coalesce("merchant_id", "individual_id"), r"(\d+)$", 1)
    account = F.concat(F.lit(" "), user, F.lpad(k.cast("string"), 3, "0"), F.lit(" "))
    return w.events.filter(number >= 0).select(
        "transaction_id", normalized_status(spelled).alias("status"), masked_last4(account).alias("account_ref")
    )


def _k(_events: DataFrame):
    """The source property behind an event, read back from its response time."""
    first = F.element_at(F.map_values("network_response_details"), 1).cast("int")
    return ((first - 100) / 10).cast("int")


def _raw_rows(w: Workbench) -> DataFrame:
    """Events as all-text rows of the shared file layout, some of them unreadable."""
    k = _k(w.events)
    merchant = F.col("merchant_id").isNotNull()
    position = F.struct(F.lit(0).cast("long").alias("block"), F.col("event_ordinal").cast("long").alias("row"))
    return w.events.select(
        F.when(k != 98, F.col("transaction_id")).alias("transaction_id"),
        F.coalesce("source_merchant_id", "source_individual_id").alias("entity_id"),
        F.when(merchant, "MERCHANT").otherwise("INDIVIDUAL").alias("entity_type"),
        F.col("payer_name").alias("entity_name"),
        F.col("payee_name").alias("counterparty_name"),
        F.when(k == 99, "12,5").otherwise(k.cast("string")).alias("amount"),
        F.lower("status").alias("settlement_status"),
        F.when(k % 2 == 0, "CLEAR").alias("sanctions_screening_status"),
        F.lit("OK").alias("compliance_status"),
        F.lit("x").alias("settled_amount"),
        position.alias(POSITION),
    )


@query(
    """SELECT CASE WHEN k <> 98 THEN transaction_id END AS transaction_id, source_merchant_id,
 CASE WHEN source_merchant_id IS NULL THEN source_individual_id END AS source_individual_id, payer_name, payee_name,
 CASE WHEN k <> 99 THEN k::DOUBLE END AS amount, status, 1 + (k % 2 = 0)::INT AS risk_entries, k IN (98, 99) AS failed FROM ev"""
)
def mapped_projection(w: Workbench) -> DataFrame:
    projected = mapping.project(_raw_rows(w), [m for m in layouts.shared_layout("BANK") if m.rail_type == "ACH"])
    return projected.select(
        "transaction_id",
        "source_merchant_id",
        "source_individual_id",
        "payer_name",
        "payee_name",
        "amount",
        "status",
        F.size("risk_flags").alias("risk_entries"),
        F.col("error").isNotNull().alias("failed"),
    )


@query(
    """SELECT 'ACH' AS rail_type, count(*) AS row_count, count(*) FILTER (k NOT IN (98, 99)) AS rows_mapped, count(*) FILTER (k IN (98, 99)) AS rows_failed,
 'settled_amount,entity_type' AS unmapped_columns FROM ev"""
)
def ingestion_log(w: Workbench) -> DataFrame:
    rows = _raw_rows(w)
    mappings = [m for m in layouts.shared_layout("BANK") if m.rail_type == "ACH"]
    log = mapping.ingestion_log(mapping.project(rows, mappings), rows, mappings, "BANK", "ACH", "POST", "events")
    return log.select(
        "rail_type", "row_count", "rows_mapped", "rows_failed", F.reverse(F.array_sort("unmapped_columns")).alias("unmapped_columns")
    )


_MERGED_SQL = """SELECT tenant_bank_id, rail_type, transaction_id, payer_name, CASE WHEN k < 80 THEN coalesce(status, 'INITIATED') ELSE 'INITIATED' END AS status,
 CASE WHEN k < 80 THEN reconciliation_status END AS reconciliation_status, CASE WHEN k < 80 THEN reconciliation_variance_amount END AS reconciliation_variance_amount,
 round(amount, 6) AS amount, CASE WHEN k < 80 THEN 4 ELSE 2 END AS response_entries, CASE WHEN k < 80 THEN CAST(k AS VARCHAR) END AS response_code,
 CASE WHEN k < 80 THEN 'old ' || CAST(k AS VARCHAR) END AS unnamed_entry, CAST(100 + 10 * k AS VARCHAR) AS response_time,
 'pre ' || transaction_id AS pre_row, CASE WHEN k < 80 THEN 'post ' || transaction_id END AS post_row, event_ordinal AS position FROM ev"""


def _pre_and_post(w: Workbench) -> tuple[DataFrame, DataFrame]:
    """PRE arrivals of every event and POST arrivals of most, some with a blank payer name or an entry no mapping names."""
    k = _k(w.events)
    mapped = w.events.select(
        "tenant_bank_id",
        "rail_type",
        "transaction_id",
        *((F.col(f) if f in w.events.columns else F.lit(None)).cast(t).alias(f) for f, t in MAPPED_FIELDS.items()),
        k.alias("k"),
        "event_ordinal",
    )
    pre = mapped.withColumns(
        {
            "status": F.lit("INITIATED"),
            "reconciliation_status": F.lit(None).cast("string"),
            "reconciliation_variance_amount": F.lit(None).cast("double"),
        }
    )
    entries = F.create_map(
        F.lit("response_code"), k.cast("string"), F.lit("unnamed"), F.concat(F.lit("old "), k.cast("string"))
    )
    post = mapped.filter(k < 80).withColumns(
        {
            "payer_name": F.when(k % 6 == 0, " ").otherwise(F.col("payer_name")),
            "network_response_details": F.map_concat("network_response_details", entries),
        }
    )

    def stamped(rows: DataFrame, number: int, name: str) -> DataFrame:
        return rows.select(
            *(c for c in rows.columns if c not in ("k", "event_ordinal")),
            F.lit(name == "pre").alias("is_pre"),
            F.create_map(F.lit("row"), F.concat(F.lit(f"{name} "), F.col("transaction_id"))).alias("raw_row"),
            F.struct(F.lit(number).alias("file"), F.col("event_ordinal").alias("position")).alias("arrival_seq"),
            F.lit(DETECTED_AT).cast("timestamp").alias("arrived_at"),
        )

    return stamped(pre, 0, "pre"), stamped(post, 1, "post")


_RESPONSE_KEYS = {
    "network_response_details": [
        "network_response_control.response_time_ms",
        "network_response_control.expected_response_sla_ms",
        "clearing_network_response.response_time_ms",
        "clearing_network_response.expected_response_sla_ms",
        "response_code",
    ]
}


def _merged_columns(merged: DataFrame) -> DataFrame:
    details = F.col("network_response_details")
    return merged.select(
        "tenant_bank_id",
        "rail_type",
        "transaction_id",
        "payer_name",
        "status",
        "reconciliation_status",
        "reconciliation_variance_amount",
        "amount",
        F.size(details).alias("response_entries"),
        F.try_element_at(details, F.lit("response_code")).alias("response_code"),
        F.try_element_at(details, F.lit("unnamed")).alias("unnamed_entry"),
        map_value_by_suffix(details, ".response_time_ms").alias("response_time"),
        F.try_element_at("snapshot_pre", F.lit("row")).alias("pre_row"),
        F.try_element_at("snapshot_post", F.lit("row")).alias("post_row"),
        F.col("event_ordinal.position").alias("position"),
    )


@query(_MERGED_SQL)
def canonical_merge(w: Workbench) -> DataFrame:
    """Both files of every event in one run."""
    pre, post = _pre_and_post(w)
    return _merged_columns(merge.canonical_merge(pre.unionByName(post), _RESPONSE_KEYS))


@query(_MERGED_SQL)
def canonical_merge_again(w: Workbench) -> DataFrame:
    """The later file merged into the events that an earlier run left."""
    pre, post = _pre_and_post(w)
    known = merge.canonical_merge(pre, _RESPONSE_KEYS)
    return _merged_columns(merge.canonical_merge(post, _RESPONSE_KEYS, existing=known))


@query(
    """SELECT event_ordinal, strftime(CASE k % 7 WHEN 0 THEN t WHEN 1 THEN date_trunc('hour', t) WHEN 2 THEN t - INTERVAL 1 HOUR WHEN 3 THEN t
 WHEN 4 THEN date_trunc('day', t) WHEN 5 THEN t + INTERVAL 330 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') AS occurred
 FROM (SELECT *, strptime(transaction_occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS t FROM ev)"""
)
def time_forms(w: Workbench) -> DataFrame:
    """Instants read back from texts of several ISO forms; one form that is none stays null."""
    at, k = parse_iso(F.col("transaction_occurred_at")), _k(w.events)
    forms = {
        0: F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"),
        1: F.date_format(at, "yyyy-MM-dd'T'HH"),
        2: F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01")),
        3: F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(",123456789")),
        4: F.date_format(at, "yyyy-MM-dd"),
        5: F.concat(F.date_format(at, "yyyy-MM-dd'T'HHmmss"), F.lit(".5-0530")),
        6: F.date_format(at, "dd.MM.yyyy HH:mm"),
    }
    text = F.coalesce(*(F.when(k % len(forms) == n, form) for n, form in forms.items()))
    return w.events.select("event_ordinal", F.date_trunc("second", parse_iso(text)).alias("occurred"))


# --- identity -----------------------------------------------------------------

_MERCHANT_ID = "'MER-' || upper(substr(sha256(tenant_bank_id || '|' || source_merchant_id), 1, 16))"
_INDIVIDUAL_ID = "'IND-' || upper(substr(sha256(tenant_bank_id || '|' || source_individual_id), 1, 16))"


@query(
    f"""SELECT {_MERCHANT_ID} AS merchant_id, tenant_bank_id, source_merchant_id, arg_min(payer_name, event_ordinal) FILTER (payer_name IS NOT NULL) AS legal_name, true AS is_new
 FROM ev WHERE source_merchant_id IS NOT NULL GROUP BY tenant_bank_id, source_merchant_id"""
)
def merchant_registry(w: Workbench) -> DataFrame:
    return w.merchants.select("merchant_id", "tenant_bank_id", "source_merchant_id", "legal_name", "is_new")


@query(
    f"""SELECT {_INDIVIDUAL_ID} AS individual_id, tenant_bank_id, source_individual_id, arg_min(payer_name, event_ordinal) FILTER (payer_name IS NOT NULL) AS full_name, true AS is_new
 FROM ev WHERE source_individual_id IS NOT NULL AND source_merchant_id IS NULL GROUP BY tenant_bank_id, source_individual_id"""
)
def individual_registry(w: Workbench) -> DataFrame:
    return w.individuals.select("individual_id", "tenant_bank_id", "source_individual_id", "full_name", "is_new")


@query(
    f"""SELECT transaction_id, CASE WHEN source_merchant_id IS NOT NULL THEN {_MERCHANT_ID} END AS merchant_id,
 CASE WHEN source_merchant_id IS NULL AND source_individual_id IS NOT NULL THEN {_INDIVIDUAL_ID} END AS individual_id FROM ev"""
)
def resolved_events(w: Workbench) -> DataFrame:
    return identity.resolve_events(w.unresolved).select("transaction_id", "merchant_id", "individual_id")



_SOURCE_NUMBER = "substr({0}, 2)::BIGINT"
_OLD_MERCHANT = _SOURCE_NUMBER.format("source_merchant_id") + " % 2 = 0"
_OLD_INDIVIDUAL = _SOURCE_NUMBER.format("source_individual_id") + " % 3 = 0"


def _known_before(registry: DataFrame, identity_column: str, source: str, every: int) -> DataFrame:
    """What an earlier run may have left: some of the parties, under ids of its own, few of them with a name."""
    number = F.substring(source, 2, 18).cast("long")
    name = "legal_name" if identity_column == "merchant_id" else "full_name"
    known = registry.filter(number % every == 0).drop("is_new")
    return known.withColumns({identity_column: F.concat(F.lit("OLD-"), source), name: F.when(number % 4 == 0, F.concat(F.lit("known "), source))})


@query(
    f"""SELECT transaction_id, CASE WHEN {_OLD_MERCHANT} THEN 'OLD-' || source_merchant_id WHEN source_merchant_id IS NOT NULL THEN {_MERCHANT_ID} END AS merchant_id,
 CASE WHEN source_merchant_id IS NOT NULL THEN NULL WHEN {_OLD_INDIVIDUAL} THEN 'OLD-' || source_individual_id WHEN source_individual_id IS NOT NULL THEN {_INDIVIDUAL_ID} END AS individual_id FROM ev"""
)
def resolved_events_again(w: Workbench) -> DataFrame:
    """Ids that an earlier registry issued are kept."""
    merchants = _known_before(w.merchants, "merchant_id", "source_merchant_id", 2)
    individuals = _known_before(w.individuals, "individual_id", "source_individual_id", 3)
    return identity.resolve_events(w.unresolved, merchants, individuals).select("transaction_id", "merchant_id", "individual_id")


@query(
    f"""SELECT CASE WHEN {_OLD_MERCHANT} THEN 'OLD-' || source_merchant_id ELSE {_MERCHANT_ID} END AS merchant_id, tenant_bank_id, source_merchant_id,
 CASE WHEN {_SOURCE_NUMBER.format('source_merchant_id')} % 4 = 0 THEN 'known ' || source_merchant_id ELSE arg_min(payer_name, event_ordinal) FILTER (payer_name IS NOT NULL) END AS legal_name,
 {_SOURCE_NUMBER.format('source_merchant_id')} % 2 <> 0 AS is_new FROM ev WHERE source_merchant_id IS NOT NULL GROUP BY tenant_bank_id, source_merchant_id"""
)
def merchant_registry_again(w: Workbench) -> DataFrame:
    """A known name stays, a missing one is filled."""
    found = identity.merchant_registry(w.unresolved, _known_before(w.merchants, "merchant_id", "source_merchant_id", 2))
    return found.select("merchant_id", "tenant_bank_id", "source_merchant_id", "legal_name", "is_new")


@query(
    f"""SELECT CASE WHEN {_OLD_INDIVIDUAL} THEN 'OLD-' || source_individual_id ELSE {_INDIVIDUAL_ID} END AS individual_id, tenant_bank_id, source_individual_id,
 CASE WHEN {_SOURCE_NUMBER.format('source_individual_id')} % 12 = 0 THEN 'known ' || source_individual_id ELSE arg_min(payer_name, event_ordinal) FILTER (payer_name IS NOT NULL) END AS full_name,
 {_SOURCE_NUMBER.format('source_individual_id')} % 3 <> 0 AS is_new FROM ev WHERE source_individual_id IS NOT NULL AND source_merchant_id IS NULL GROUP BY tenant_bank_id, source_individual_id"""
)
def individual_registry_again(w: Workbench) -> DataFrame:
    found = identity.individual_registry(w.unresolved, _known_before(w.individuals, "individual_id", "source_individual_id", 3))
    return found.select("individual_id", "tenant_bank_id", "source_individual_id", "full_name", "is_new")


@query(
    """SELECT tenant_bank_id, count(*) FILTER (source_merchant_id IS NOT NULL) AS resolved_merchants,
 count(*) FILTER (source_merchant_id IS NULL AND source_individual_id IS NOT NULL) AS resolved_individuals,
 count(*) FILTER (source_merchant_id IS NULL AND source_individual_id IS NULL) AS skipped_without_source,
 count(*) FILTER (source_merchant_id IS NOT NULL AND source_individual_id IS NOT NULL) AS exclusivity_warnings,
 count(DISTINCT source_merchant_id) AS created_new_merchants,
 count(DISTINCT CASE WHEN source_merchant_id IS NULL THEN source_individual_id END) AS created_new_individuals FROM ev GROUP BY ALL"""
)
def party_resolution(w: Workbench) -> DataFrame:
    return identity.resolution_counts(w.unresolved, w.merchants, w.individuals)


@query(
    """SELECT tenant_bank_id, rail_type, transaction_id, 'mutual_exclusivity_warning' AS type FROM ev
 WHERE source_merchant_id IS NOT NULL AND source_individual_id IS NOT NULL"""
)
def exclusivity_warnings(w: Workbench) -> DataFrame:
    return identity.exclusivity_warnings(w.unresolved)


@query(
    """SELECT c.tenant_bank_id, c.merchant_id, c.legal_name, count(*) AS transaction_count, array_to_string(list_sort(list(DISTINCT rail_type)), ',') AS rails_active
 FROM (SELECT tenant_bank_id, merchant_id, arg_min(payer_name, event_ordinal) FILTER (payer_name IS NOT NULL) AS legal_name FROM ev WHERE merchant_id IS NOT NULL GROUP BY ALL) c
 JOIN ev ON ev.tenant_bank_id = c.tenant_bank_id AND ev.merchant_id = c.merchant_id WHERE c.legal_name ILIKE '%party-1%' OR c.merchant_id ILIKE '%party-1%' GROUP BY ALL"""
)
def directory_search(w: Workbench) -> DataFrame:
    registry = w.merchants.withColumn("merchant_id", F.concat(F.lit("MER-"), F.substring("source_merchant_id", 2, 20)))
    found = identity.directory(registry, w.events, "merchant_id", ["legal_name"], "Party-1")
    return found.select("tenant_bank_id", "merchant_id", "legal_name", "transaction_count", "rails_active")


# --- snapshots and scores -----------------------------------------------------


@query(
    f"""SELECT snapshot_id, tenant_bank_id, party_id, party_type, segment, window_type, {_iso('window_start', 'window_end')}, transaction_count,
 {_r('amount_total', 'amount_avg', 'amount_median', 'amount_std')}, unique_counterparties,
 {_r('new_counterparty_ratio', 'retry_ratio', 'avg_response_time_ms', 'timeout_ratio', 'format_reject_ratio', 'near_threshold_ratio')}, rails_used,
 {_r('account_age_days')}, split FROM snap"""
)
def entity_snapshots(w: Workbench) -> DataFrame:
    return w.snapshots.drop("timeseries_drift_score")


@query(
    """SELECT tenant_bank_id, count(*) FILTER (k % 17 = 0) AS skipped_no_timestamp, count(*) FILTER (k % 17 <> 0 AND k % 19 = 0) AS skipped_unreadable
 FROM ev GROUP BY tenant_bank_id HAVING count(*) FILTER (k % 17 = 0 OR k % 19 = 0) > 0"""
)
def undated_count(w: Workbench) -> DataFrame:
    """Events some of which have no time, and some one that cannot be read."""
    k = _k(w.events)
    text = F.when(k % 17 != 0, F.when(k % 19 == 0, F.concat(F.lit("at "), "transaction_occurred_at")).otherwise(F.col("transaction_occurred_at")))
    return snapshots.undated_count(w.events.withColumn("transaction_occurred_at", text))


@query(
    """SELECT s.tenant_bank_id, strftime(cutoff, '%Y-%m-%dT%H:%M:%SZ') AS cutoff, split, window_type, count(*) AS snapshots FROM snap s GROUP BY ALL"""
)
def snapshot_split(w: Workbench) -> DataFrame:
    cutoffs = snapshots.split_cutoffs(snapshots.dated_party_events(w.events))
    counts = w.snapshots.groupBy("tenant_bank_id", "split", "window_type").agg(F.count(F.lit(1)).alias("snapshots"))
    return counts.join(cutoffs, "tenant_bank_id")


@query(
    f"""SELECT snapshot_id, tenant_bank_id, beneficiary_key, beneficiary_name, {_iso('window_start', 'window_end')}, transaction_count, {_r('amount_total')},
 distinct_senders, distinct_new_senders, {_r('new_sender_ratio')}, sender_party_types FROM ben"""
)
def beneficiary_snapshots(w: Workbench) -> DataFrame:
    return w.beneficiaries.drop("funnel_drift_score")


@query(f"SELECT snapshot_id, {_r('timeseries_drift_score')} FROM snap WHERE window_type = 'WEEKLY'")
def merchant_drift(w: Workbench) -> DataFrame:
    return w.snapshots.filter("window_type = 'WEEKLY'").select("snapshot_id", "timeseries_drift_score")


@query(f"SELECT snapshot_id, {_r('funnel_drift_score')}, CASE WHEN funnel_drift_score >= 50 THEN 'Funnel Account' ELSE '' END AS categories FROM ben")
def funnel_drift(w: Workbench) -> DataFrame:
    return scoring.with_funnel_tag(w.beneficiaries).select("snapshot_id", "funnel_drift_score", "categories")


@query("SELECT snapshot_id, anomaly_band, categories FROM tagged")
def category_tags(w: Workbench) -> DataFrame:
    return scoring.with_tags(w.banded).select("snapshot_id", "anomaly_band", "categories")


@query(
    """SELECT tenant_bank_id, known_count, newly_discovered_count, known_count + newly_discovered_count AS total,
 round(known_count / nullif(known_count + newly_discovered_count, 0), 6) AS known_rate, round(newly_discovered_count / nullif(known_count + newly_discovered_count, 0), 6) AS newly_discovered_rate
 FROM (SELECT tenant_bank_id, count(*) FILTER (known) AS known_count, count(*) FILTER (NOT known) AS newly_discovered_count FROM (
 SELECT tenant_bank_id, categories <> '' AS known FROM tagged WHERE anomaly_band IN ('High', 'Critical') UNION ALL SELECT tenant_bank_id, true FROM ben WHERE funnel_drift_score >= 50) GROUP BY ALL)"""
)
def drift_pattern_mix(w: Workbench) -> DataFrame:
    return scoring.pattern_mix(scoring.with_tags(w.banded), w.beneficiaries)


@query(
    """SELECT tenant_bank_id, segment, count(*) FILTER (n < 50) AS segment_baseline, count(*) FILTER (n BETWEEN 50 AND 200) AS entity_specific, count(*) FILTER (n > 200) AS full_model
 FROM (SELECT tenant_bank_id, segment, party_id, sum(transaction_count) AS n FROM snap GROUP BY ALL) GROUP BY ALL"""
)
def observation_tiers(w: Workbench) -> DataFrame:
    return forest.tier_counts(forest.party_tiers(w.snapshots))


@query(
    f"""SELECT tenant_bank_id, segment, {', '.join(f"round(coalesce(median({f}) FILTER (split = 'train'), 0), 6) AS median_{f}" for f in vectors.FOREST_FEATURES)} FROM snap GROUP BY ALL"""
)
def segment_medians(w: Workbench) -> DataFrame:
    return vectors.segment_medians(vectors.training_rows(w.snapshots), vectors.FOREST_FEATURES)


@query()
def isolation_forest(w: Workbench) -> DataFrame:
    return w.forest_scores


# Ranks within a segment are unique, so the rescaled scores run evenly from 0 to 100.
@query(
    """SELECT tenant_bank_id, segment, count(DISTINCT party_id) AS parties, count(*) FILTER (split = 'train') AS train_rows, count(*) AS rows_scored, 0.0::DOUBLE AS score_min,
 CASE WHEN count(*) > 1 THEN 100.0 ELSE 0.0 END::DOUBLE AS score_max, CASE WHEN count(*) > 1 THEN 50.0 ELSE 0.0 END::DOUBLE AS score_median FROM snap GROUP BY ALL"""
)
def forest_summary(w: Workbench) -> DataFrame:
    return forest.score_summary(w.snapshots, w.forest_scores)


@query()
def density_clusters(w: Workbench) -> DataFrame:
    return w.clustered.select("snapshot_id", "tenant_bank_id", "segment", "cluster_id")


@query()
def cluster_changes(w: Workbench) -> DataFrame:
    return w.clustered.select("snapshot_id", "party_id", "window_type", "cluster_id", "cluster_changed")


@query()
def cluster_summary(w: Workbench) -> DataFrame:
    return density.cluster_summary(w.clustered)


@query("SELECT tenant_bank_id, segment, count(*) AS rows_clustered, count(DISTINCT party_id) AS distinct_parties FROM snap GROUP BY ALL")
def cluster_coverage(w: Workbench) -> DataFrame:
    return density.cluster_summary(w.clustered).select("tenant_bank_id", "segment", "rows_clustered", "distinct_parties")


# Signals derived from a digest of the snapshot, which SQL can state too.
_DERIVED = """(SELECT *, CASE WHEN window_type = 'WEEKLY' THEN cluster_id <> lag(cluster_id) OVER (PARTITION BY tenant_bank_id, party_id, window_type ORDER BY window_start) END AS cluster_changed
 FROM (SELECT *, ('0x' || substr(md5(snapshot_id), 1, 2))::INTEGER % 3 AS cluster_id, ('0x' || substr(md5(snapshot_id), 3, 2))::INTEGER % 101 AS forest_score FROM snap))"""


def _derived_signals(w: Workbench) -> DataFrame:
    def digits(start: int) -> Column:
        return F.conv(F.substring(F.md5(F.col("snapshot_id").cast("binary")), start, 2), 16, 10).cast("int")

    rows = w.snapshots.withColumn("cluster_id", digits(1) % 3).withColumn("isolation_forest_score", (digits(3) % 101).cast("double"))
    return density.with_cluster_change(rows)


@query(f"SELECT snapshot_id, cluster_changed FROM {_DERIVED}")
def derived_cluster_changes(w: Workbench) -> DataFrame:
    return _derived_signals(w).select("snapshot_id", "cluster_changed")


@query(
    f"""SELECT snapshot_id, round(score, 6) AS final_anomaly_score, CASE WHEN score < 30 THEN 'Normal' WHEN score < 60 THEN 'Low-Medium' WHEN score < 80 THEN 'High' ELSE 'Critical' END AS anomaly_band
 FROM (SELECT snapshot_id, 0.4::DOUBLE * forest_score + 0.25::DOUBLE * CASE WHEN cluster_changed THEN 100.0 ELSE 0.0 END + 0.35::DOUBLE * coalesce(timeseries_drift_score, 0.0) AS score FROM {_DERIVED})"""
)
def derived_final_scores(w: Workbench) -> DataFrame:
    return scoring.with_final_score(_derived_signals(w)).select("snapshot_id", "final_anomaly_score", "anomaly_band")


@query(
    """SELECT tenant_bank_id, segment, party_id, n AS observations, CASE WHEN n > 200 THEN 'FULL_MODEL' ELSE 'ENTITY_SPECIFIC' END AS tier
 FROM (SELECT tenant_bank_id, segment, party_id, sum(transaction_count)::BIGINT AS n FROM snap GROUP BY ALL) WHERE n >= 50"""
)
def tier_warnings(w: Workbench) -> DataFrame:
    return forest.upgraded_parties(w.snapshots)


@query()
def cluster_sizes(w: Workbench) -> DataFrame:
    return density.cluster_sizes(w.clustered)


@query()
def pca_projection(w: Workbench) -> DataFrame:
    projected = vectors.cluster_vectors(w.snapshots, include_structuring=True)
    return projected.select("snapshot_id", "segment", F.size("x").alias("components"), F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query()
def final_scores(w: Workbench) -> DataFrame:
    return w.scored.select(
        "snapshot_id", "isolation_forest_score", "cluster_changed", "timeseries_drift_score", "final_anomaly_score", "anomaly_band"
    )


@query()
def pattern_mix(w: Workbench) -> DataFrame:
    return scoring.pattern_mix(scoring.with_tags(w.scored), w.beneficiaries)


# --- rules --------------------------------------------------------------------

_DUPLICATES = "SELECT 'DUPLICATE_PAYMENT|' || tenant_bank_id || '|' || link_key AS issue_id, tenant_bank_id, reference_id FROM groups"


@query(_DUPLICATES)
def duplicate_payments(w: Workbench) -> DataFrame:
    return operations.duplicate_payments(w.events, DETECTED_AT).select("issue_id", "tenant_bank_id", "reference_id")


@query(_DUPLICATES + " WHERE link_key LIKE 'RETRY-LINK:%'")
def retry_link_duplicates(w: Workbench) -> DataFrame:
    return operations.retry_link_duplicates(w.events, DETECTED_AT).select("issue_id", "tenant_bank_id", "reference_id")


@query(
    """SELECT e.tenant_bank_id, e.idempotency_key AS link_key, transaction_id, rail_type, coalesce(status = 'SETTLED', false) AS is_settled
 FROM ev e JOIN groups g ON g.tenant_bank_id = e.tenant_bank_id AND g.link_key = e.idempotency_key
 UNION ALL SELECT DISTINCT p.tenant_bank_id, p.link_key, x.t, x.r, coalesce(x.s = 'SETTLED', false) FROM pairs p JOIN groups g USING (tenant_bank_id, link_key),
 LATERAL (SELECT p.rt AS t, p.rr AS r, p.rs AS s UNION ALL SELECT p.ot, p.orr, p.os) x"""
)
def duplicate_members(w: Workbench) -> DataFrame:
    return operations.duplicate_members(w.events)


_ISSUE_COLUMNS = ("issue_id", "tenant_bank_id", "reference_type", "reference_id", "window_start", "window_end", "severity_score", "days_overdue")
_ISSUES = f"SELECT issue_id, tenant_bank_id, reference_type, reference_id, {_iso('window_start', 'window_end')}, {_r('severity_score')}, days_overdue FROM issue WHERE issue_type = "


@query(_ISSUES + "'FORMAT_REJECTION'")
def format_rejections(w: Workbench) -> DataFrame:
    return operations.format_rejections(w.events, DETECTED_AT).select(*_ISSUE_COLUMNS)


@query(_ISSUES + "'FORMAT_REJECTION_SPIKE'")
def format_rejection_spikes(w: Workbench) -> DataFrame:
    return operations.format_rejection_spikes(w.snapshots, DETECTED_AT).select(*_ISSUE_COLUMNS)


@query(_ISSUES + "'BATCH_NOT_SETTLED'")
def unsettled_batches(w: Workbench) -> DataFrame:
    return operations.unsettled_batches(w.events, AS_OF, DETECTED_AT).select(*_ISSUE_COLUMNS)


@query(_ISSUES + "'NETWORK_TIMEOUT_SPIKE'")
def timeout_spikes(w: Workbench) -> DataFrame:
    return operations.timeout_spikes(w.snapshots, DETECTED_AT).select(*_ISSUE_COLUMNS)


@query(
    f"SELECT break_id, tenant_bank_id, transaction_id, rail_type, detection_type, source_reconciliation_status, {_r('variance_amount', 'amount')} FROM brk"
)
def reconciliation_breaks(w: Workbench) -> DataFrame:
    columns = ["break_id", "tenant_bank_id", "transaction_id", "rail_type", "detection_type", "source_reconciliation_status"]
    return w.breaks.select(*columns, "variance_amount", "amount")


@query(f"SELECT issue_id, {_r('priority_score')}, priority_level FROM ranked")
def issue_priority(w: Workbench) -> DataFrame:
    return w.ranked_issues.select("issue_id", "priority_score", "priority_level")


@query(f"SELECT break_id, {_r('priority_score')}, priority_level FROM rbrk")
def break_priority(w: Workbench) -> DataFrame:
    return w.ranked_breaks.select("break_id", "priority_score", "priority_level")


@query(f"SELECT issue_id, issue_type, {_r('priority_score')} FROM ranked WHERE tenant_bank_id = 'BANK_1' AND issue_type = 'DUPLICATE_PAYMENT' AND priority_level = 'Critical'")
def critical_duplicates(w: Workbench) -> DataFrame:
    found = listings.issues(w.ranked_issues, "BANK_1", "duplicate_payment", "critical")
    return found.select("issue_id", "issue_type", "priority_score")



@query(f"SELECT issue_id, issue_type, {_r('priority_score')}, (SELECT count(*) FROM ranked) AS total FROM ranked ORDER BY ranked.priority_score DESC, issue_id LIMIT 25 OFFSET 800")
def issue_page(w: Workbench) -> DataFrame:
    """A page deep in the listing of issues, the most urgent first."""
    order = [F.desc("priority_score"), F.asc("issue_id")]
    found = listings.page(w.ranked_issues, order, 25, 800, -F.floor("priority_score"))
    return found.rows.select("issue_id", "issue_type", "priority_score", F.lit(found.total).alias("total"))


@query(f"SELECT break_id, {_r('priority_score')} FROM rbrk WHERE tenant_bank_id = 'BANK_2' AND detection_type = 'CONFIRMED_BREAK' AND priority_level = 'Medium'")
def medium_confirmed_breaks(w: Workbench) -> DataFrame:
    found = listings.breaks(w.ranked_breaks, "BANK_2", "confirmed_break", "medium")
    return found.select("break_id", "priority_score")


@query(f"SELECT snapshot_id, categories FROM tagged {_END_WINDOW} AND segment = 'MERCHANT' AND tenant_bank_id = 'BANK_0'")
def snapshot_listing(w: Workbench) -> DataFrame:
    found = listings.snapshots(scoring.with_tags(w.banded), tenant="BANK_0", segment="MERCHANT", start=START, end=END)
    return found.select("snapshot_id", "categories")


@query(f"SELECT snapshot_id, beneficiary_key, transaction_count FROM ben {_END_WINDOW} AND tenant_bank_id = 'BANK_0'")
def beneficiary_listing(w: Workbench) -> DataFrame:
    found = listings.beneficiaries(w.beneficiaries, "BANK_0", start=START, end=END)
    return found.select("snapshot_id", "beneficiary_key", "transaction_count")


# --- health and review --------------------------------------------------------

_HEALTH = """SELECT tenant_bank_id, score AS health_score, CASE WHEN score >= 85 THEN 'Healthy' WHEN score >= 70 THEN 'Watch' WHEN score >= 50 THEN 'At Risk' ELSE 'Critical' END AS health_band,
 round_even(c1, 1) AS settlement_component, round_even(c2, 1) AS anomaly_component, round_even(c3, 1) AS operational_component, round_even(c4, 1) AS reconciliation_component,
 total_transactions, settled_transactions, total_scored_entities, critical_anomaly_count, high_anomaly_count, operational_issue_count, reconciliation_break_count
 FROM (SELECT *, round_even(greatest(0.0, least(100.0, c1 * 0.3::DOUBLE + c2 * 0.3::DOUBLE + c3 * 0.2::DOUBLE + c4 * 0.2::DOUBLE)), 1) AS score FROM (SELECT *,
 greatest(0.0, 100 - (1 - settled_transactions / total_transactions) * 100) AS c1, greatest(0.0, 100 - (2 * critical_anomaly_count + high_anomaly_count) / total_scored_entities * 100) AS c2,
 greatest(0.0, 100 - operational_issue_count / total_transactions * 100) AS c3, greatest(0.0, 100 - reconciliation_break_count / checked * 100) AS c4 FROM
 (SELECT tenant_bank_id, count(*) AS total_transactions, count(*) FILTER (status = 'SETTLED') AS settled_transactions, count(reconciliation_status) AS checked FROM ev GROUP BY ALL)
 JOIN (SELECT tenant_bank_id, count(*) AS total_scored_entities, count(*) FILTER (anomaly_band = 'Critical') AS critical_anomaly_count, count(*) FILTER (anomaly_band = 'High') AS high_anomaly_count FROM banded GROUP BY ALL) USING (tenant_bank_id)
 JOIN (SELECT tenant_bank_id, count(*) AS operational_issue_count FROM issue GROUP BY ALL) USING (tenant_bank_id)
 JOIN (SELECT tenant_bank_id, count(*) AS reconciliation_break_count FROM brk GROUP BY ALL) USING (tenant_bank_id)))"""


def _health(w: Workbench) -> DataFrame:
    return health.health_scores(w.events, w.banded, w.issues, w.breaks, DETECTED_AT)


@query(_HEALTH)
def health_scores(w: Workbench) -> DataFrame:
    return _health(w).drop("computed_at")


_COUNTS = "SELECT tenant_bank_id, signal_type, count(*) AS total, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'DISMISSED') AS dismissed FROM judged {0} GROUP BY ALL"
_SUMMARY = f"""SELECT tenant_bank_id, sum(total)::BIGINT AS total_claims, sum(confirmed)::BIGINT AS confirmed, sum(dismissed)::BIGINT AS dismissed,
 (sum(total) - sum(confirmed) - sum(dismissed))::BIGINT AS pending, round_even((sum(confirmed) + sum(dismissed)) / sum(total), 3) AS review_rate FROM ({_COUNTS}) GROUP BY ALL"""


@query(_SUMMARY.format(""))
def review_summary(w: Workbench) -> DataFrame:
    return review.review_summary(review.review_counts(w.claim_ids, w.reviews))


@query(_SUMMARY.format(_TIME_WINDOW))
def review_summary_in_window(w: Workbench) -> DataFrame:
    scoped = review.claim_ids(w.found_issues, w.found_breaks, w.banded, w.beneficiaries, START, END)
    return review.review_summary(review.review_counts(scoped, w.reviews))


@query(
    f"SELECT tenant_bank_id, signal_type, total AS total_claims, confirmed + dismissed AS reviewed, total - confirmed - dismissed AS pending FROM ({_COUNTS.format('')})"
)
def review_summary_by_type(w: Workbench) -> DataFrame:
    return review.review_summary_by_type(review.review_counts(w.claim_ids, w.reviews))


@query(
    """SELECT tenant_bank_id, reviewed_at, arg_max(reviewed_count, reviewed_count) AS reviewed_count, round(arg_max(confirmed / reviewed_count, reviewed_count), 6) AS confirmation_rate,
 round(arg_max((reviewed_count - confirmed) / reviewed_count, reviewed_count), 6) AS false_positive_rate FROM (
 SELECT tenant_bank_id, strftime(reviewed_at, '%Y-%m-%dT%H:%M:%SZ') AS reviewed_at, count(*) OVER t AS reviewed_count, count(*) FILTER (status = 'CONFIRMED') OVER t AS confirmed
 FROM reviews WINDOW t AS (PARTITION BY tenant_bank_id ORDER BY reviews.reviewed_at RANGE UNBOUNDED PRECEDING)) GROUP BY ALL"""
)
def quality_trend(w: Workbench) -> DataFrame:
    """The running rates as they stand after each instant of the trend."""
    points = review.quality_trend(w.reviews)
    last = F.max_by(F.struct("reviewed_count", "confirmation_rate", "false_positive_rate"), "reviewed_count").alias("p")
    return points.groupBy("tenant_bank_id", "reviewed_at").agg(last).select("tenant_bank_id", "reviewed_at", "p.*")


@query(
    """SELECT r.tenant_bank_id, strftime(reviewed_at::DATE, '%Y-%m-%d') AS date, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'DISMISSED') AS dismissed
 FROM reviews r JOIN (SELECT tenant_bank_id, max(reviewed_at)::DATE AS latest FROM reviews GROUP BY ALL) USING (tenant_bank_id) WHERE reviewed_at::DATE >= latest - 6 GROUP BY ALL"""
)
def quality_trend_daily(w: Workbench) -> DataFrame:
    return review.quality_trend_daily(w.reviews)


# --- exposure -----------------------------------------------------------------


@query(f"SELECT signal_type, tenant_bank_id, reference_id, {_r('amount')}, rail_type, {_iso('occurred_ts')} FROM claim")
def claims(w: Workbench) -> DataFrame:
    return w.claims.drop("week_start")


_BY_DOMAIN = "SELECT tenant_bank_id, signal_type, label, coalesce(round_even(exposure, 2), 0) AS exposure FROM domains LEFT JOIN (SELECT tenant_bank_id, signal_type, sum(amount) AS exposure FROM claim {0} GROUP BY ALL) USING (tenant_bank_id, signal_type)"


@query(_BY_DOMAIN.format(""))
def exposure_by_domain(w: Workbench) -> DataFrame:
    return exposure.exposure_by_domain(w.claims, w.tenants)


@query(_BY_DOMAIN.format(_TIME_WINDOW))
def exposure_by_domain_in_window(w: Workbench) -> DataFrame:
    scoped = exposure.claims(w.found_issues, w.found_breaks, w.banded, START, END)
    return exposure.exposure_by_domain(scoped, w.tenants)


@query("SELECT tenant_bank_id, rail_type, round_even(sum(amount), 2) AS exposure FROM claim WHERE rail_type IS NOT NULL GROUP BY ALL")
def exposure_by_rail(w: Workbench) -> DataFrame:
    return exposure.exposure_by_rail(w.claims)


@query(
    "SELECT tenant_bank_id, strftime(date_trunc('week', occurred_ts), '%Y-%m-%dT%H:%M:%SZ') AS week_start, round_even(sum(amount), 2) AS exposure FROM claim WHERE occurred_ts IS NOT NULL GROUP BY ALL"
)
def exposure_trend(w: Workbench) -> DataFrame:
    return exposure.exposure_trend(w.claims)


@query(
    """SELECT tenant_bank_id, round_even(residual, 2) AS residual, round_even(mitigated, 2) AS mitigated, round_even(residual + mitigated, 2) AS total, round(mitigated / (residual + mitigated), 6) AS effectiveness_rate
 FROM (SELECT tenant_bank_id, coalesce(sum(amount) FILTER (NOT done), 0) AS residual, coalesce(sum(amount) FILTER (done), 0) AS mitigated FROM reviewed_claim GROUP BY ALL)"""
)
def mitigation_progress(w: Workbench) -> DataFrame:
    return exposure.mitigation_progress(w.claims, w.claim_reviews)


@query(
    """SELECT tenant_bank_id, signal_type, label, coalesce(round_even(residual, 2), 0) AS residual, coalesce(round_even(mitigated, 2), 0) AS mitigated FROM domains
 LEFT JOIN (SELECT tenant_bank_id, signal_type, coalesce(sum(amount) FILTER (NOT done), 0) AS residual, coalesce(sum(amount) FILTER (done), 0) AS mitigated FROM reviewed_claim GROUP BY ALL) USING (tenant_bank_id, signal_type)"""
)
def mitigation_by_domain(w: Workbench) -> DataFrame:
    return exposure.mitigation_by_domain(w.claims, w.claim_reviews, w.tenants)


@query(
    """SELECT tenant_bank_id, rail_type, round_even(total, 2) AS total_amount, round_even(total - hit, 2) AS protected_amount, round_even(hit, 2) AS impacted_amount FROM (
 SELECT e.tenant_bank_id, e.rail_type, total, least(coalesce(broken, 0), total) AS hit FROM (SELECT tenant_bank_id, rail_type, sum(amount) AS total FROM ev GROUP BY ALL) e
 LEFT JOIN (SELECT tenant_bank_id, rail_type, sum(abs(amount)) AS broken FROM brk GROUP BY ALL) b USING (tenant_bank_id, rail_type))"""
)
def payment_value_by_rail(w: Workbench) -> DataFrame:
    return exposure.payment_value_by_rail(w.events, w.found_breaks)


_NORMALCY = """SELECT tenant_bank_id, count(*) AS total_transactions, count(hit) AS touched_transactions, round((count(*) - count(hit)) / count(*), 6) AS rate FROM ev
 LEFT JOIN (SELECT tenant_bank_id, rail_type, transaction_id, 1 AS hit FROM brk UNION SELECT i.tenant_bank_id, e.rail_type, e.transaction_id, 1 FROM issue i JOIN ev e ON e.tenant_bank_id = i.tenant_bank_id
 AND ((i.reference_type = 'TRANSACTION' AND e.transaction_id = i.reference_id) OR (i.reference_type = 'BATCH' AND e.batch_id = i.reference_id))) USING (tenant_bank_id, rail_type, transaction_id) {0} GROUP BY ALL"""


def _touched(w: Workbench) -> DataFrame:
    overdue = issue_events(w.found_issues.filter(is_batch_issue()), w.events)
    return exposure.touched_transactions(w.found_issues, w.breaks, overdue)


@query(_NORMALCY.format(""))
def payment_normalcy(w: Workbench) -> DataFrame:
    return exposure.payment_normalcy(w.events, _touched(w))


@query(_NORMALCY.format(_EVENT_WINDOW))
def payment_normalcy_in_window(w: Workbench) -> DataFrame:
    return exposure.payment_normalcy(w.events, _touched(w), START, END)


@query(
    """SELECT tenant_bank_id, rail_type, CASE signal_type WHEN 'operational_issue' THEN 'Operational' ELSE 'Reconciliation' END AS category, count(*) AS "count" FROM claim
 WHERE rail_type IS NOT NULL AND signal_type IN ('operational_issue', 'reconciliation_break') GROUP BY ALL"""
)
def anomaly_heatmap(w: Workbench) -> DataFrame:
    return exposure.anomaly_heatmap(w.claims)


# --- dashboards ---------------------------------------------------------------

_OVERVIEW = """SELECT e.tenant_bank_id, total_transactions, settled_transactions, date_range_start, date_range_end, total_merchants, total_individuals,
 round(settled_transactions / total_transactions, 6) AS settlement_rate FROM (SELECT tenant_bank_id, count(*) FILTER ({0}) AS total_transactions, count(*) FILTER (status = 'SETTLED' AND {0}) AS settled_transactions,
 min(transaction_occurred_at) AS date_range_start, max(transaction_occurred_at) AS date_range_end, count(DISTINCT source_merchant_id) AS total_merchants,
 count(DISTINCT CASE WHEN source_merchant_id IS NULL THEN source_individual_id END) AS total_individuals FROM ev GROUP BY ALL) e"""


@query(_OVERVIEW.format("true"))
def overview(w: Workbench) -> DataFrame:
    return dashboards.overview(w.events, w.merchants, w.individuals)


@query(_OVERVIEW.format(_EVENT_WINDOW.removeprefix("WHERE ")))
def overview_in_window(w: Workbench) -> DataFrame:
    return dashboards.overview(w.events, w.merchants, w.individuals, START, END)


_FINDINGS = """SELECT tenant_bank_id, 'anomaly_band' AS kind, anomaly_band AS name, count(*) AS "count" FROM banded {1} GROUP BY ALL
 UNION ALL SELECT tenant_bank_id, 'operational_issue', issue_type, count(*) FROM found {0} GROUP BY ALL
 UNION ALL SELECT tenant_bank_id, 'reconciliation_break', detection_type, count(*) FROM brk {0} GROUP BY ALL"""


@query(_FINDINGS.format("", ""))
def finding_counts(w: Workbench) -> DataFrame:
    return dashboards.finding_counts(w.banded, w.found_issues, w.found_breaks)


@query(_FINDINGS.format(_TIME_WINDOW, _END_WINDOW))
def finding_counts_in_window(w: Workbench) -> DataFrame:
    return dashboards.finding_counts(w.banded, w.found_issues, w.found_breaks, START, END)


@query(
    f"""SELECT tenant_bank_id, h.health_score, h.health_band, r.total_claims, r.review_rate, o.total_transactions, o.settlement_rate, f.findings
 FROM ({_HEALTH}) h JOIN ({_SUMMARY.format('')}) r USING (tenant_bank_id) JOIN ({_OVERVIEW.format('true')}) o USING (tenant_bank_id)
 JOIN (SELECT tenant_bank_id, sum("count")::BIGINT AS findings FROM ({_FINDINGS.format('', '')}) GROUP BY ALL) f USING (tenant_bank_id)"""
)
def senior_overview(w: Workbench) -> DataFrame:
    rows = dashboards.senior_overview(
        dashboards.overview(w.events, w.merchants, w.individuals),
        _health(w),
        review.review_summary(review.review_counts(w.claim_ids, w.reviews)),
        dashboards.finding_counts(w.banded, w.found_issues, w.found_breaks),
    )
    findings = F.aggregate(F.map_values("engine_totals"), F.lit(0).cast("long"), lambda total, n: total + n)
    return rows.select(
        "tenant_bank_id", "health_score", "health_band", "total_claims", "review_rate", "total_transactions", "settlement_rate", findings.alias("findings")
    )


_LATENCY = """SELECT tenant_bank_id, first_rail AS rail_type, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(first_ts)) / 1000000 AS s FROM found WHERE reference_type = 'TRANSACTION' AND first_ts IS NOT NULL
 UNION ALL SELECT tenant_bank_id, rail_type, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(occurred_ts)) / 1000000 FROM brk"""


@query(f"SELECT tenant_bank_id, round(median(s), 6) AS median_detection_seconds FROM ({_LATENCY}) WHERE s >= 0 GROUP BY ALL")
def detection_latency(w: Workbench) -> DataFrame:
    return dashboards.median_latency(dashboards.detection_latencies(w.found_issues, w.found_breaks))


_BY_RAIL = f"""SELECT tenant_bank_id, rail_type, 1 - coalesce(flagged, 0) / rail_total AS success_rate, m AS median_detection_seconds FROM
 (SELECT tenant_bank_id, rail_type, count(*) AS rail_total FROM ev GROUP BY ALL) LEFT JOIN (SELECT tenant_bank_id, rail_type, count(DISTINCT t) AS flagged FROM (
 SELECT tenant_bank_id, first_rail AS rail_type, reference_id AS t FROM found WHERE reference_type = 'TRANSACTION' AND first_rail IS NOT NULL UNION ALL SELECT tenant_bank_id, rail_type, transaction_id FROM brk) GROUP BY ALL) USING (tenant_bank_id, rail_type)
 LEFT JOIN (SELECT tenant_bank_id, rail_type, median(s) AS m FROM ({_LATENCY}) WHERE s >= 0 GROUP BY ALL) USING (tenant_bank_id, rail_type)"""


@query(f"SELECT tenant_bank_id, rail_type, {_r('success_rate', 'median_detection_seconds')} FROM ({_BY_RAIL})")
def detection_performance_by_rail(w: Workbench) -> DataFrame:
    return dashboards.detection_performance_by_rail(w.events, w.found_issues, w.found_breaks)


@query(
    f"""SELECT tenant_bank_id, rail_type, {_r('success_rate', 'average')}, CASE WHEN success_rate < average - 0.05::DOUBLE THEN 'high' ELSE 'medium' END AS severity,
 printf('%.1f%% succeed on this rail, %.1f%% on average over the tenant''s rails', round(success_rate * 100, 1), round(average * 100, 1)) AS reason FROM (
 SELECT *, avg(success_rate) OVER (PARTITION BY tenant_bank_id) AS average FROM ({_BY_RAIL})) WHERE success_rate < average"""
)
def detection_attention(w: Workbench) -> DataFrame:
    by_rail = dashboards.detection_performance_by_rail(w.events, w.found_issues, w.found_breaks)
    return dashboards.detection_attention(by_rail)


@query(
    """SELECT tenant_bank_id, category, n AS "count", round(n / sum(n) OVER (PARTITION BY tenant_bank_id), 6) AS percentage FROM (
 SELECT tenant_bank_id, 'Fraud' AS category, count(*) AS n FROM banded GROUP BY ALL UNION ALL SELECT tenant_bank_id, 'Operational', count(*) FROM found GROUP BY ALL
 UNION ALL SELECT tenant_bank_id, 'Reconciliation', count(*) FROM brk GROUP BY ALL)"""
)
def detection_volume(w: Workbench) -> DataFrame:
    return dashboards.detection_volume(w.banded, w.found_issues, w.found_breaks)


@query(
    "SELECT tenant_bank_id, count(DISTINCT name) AS new_patterns_detected FROM (SELECT tenant_bank_id, issue_type AS name FROM found UNION ALL SELECT tenant_bank_id, detection_type FROM brk) GROUP BY ALL"
)
def new_patterns(w: Workbench) -> DataFrame:
    return dashboards.new_patterns(w.found_issues, w.found_breaks)


@query(
    """SELECT tenant_bank_id, rail_type, count(*) AS total_transactions, count(*) AS covered_transactions, 1.0::DOUBLE AS coverage_rate FROM ev GROUP BY ALL
 UNION ALL SELECT tenant_bank_id, NULL, count(*), count(*), 1.0::DOUBLE FROM ev GROUP BY ALL"""
)
def coverage(w: Workbench) -> DataFrame:
    return dashboards.coverage(w.events)


_MIX = """SELECT tenant_bank_id, count(*) FILTER (known) AS known_count, count(*) FILTER (NOT known) AS newly_discovered_count FROM (
 SELECT tenant_bank_id, categories <> '' AS known FROM tagged WHERE anomaly_band IN ('High', 'Critical') UNION ALL SELECT tenant_bank_id, true FROM ben WHERE funnel_drift_score >= 50) GROUP BY ALL"""


@query(
    f"""SELECT tenant_bank_id, b.early AS provisional_variance_count, round_even(b.amount, 2) AS exposure_identified_early, confirmed AS confirmed_count, dismissed AS dismissed_count,
 pending AS pending_count, round(confirmed / (confirmed + dismissed), 6) AS confirmation_rate, round(l.m, 6) AS median_detection_seconds, x.known_count, x.newly_discovered_count FROM ({_SUMMARY.format('')})
 JOIN (SELECT tenant_bank_id, count(*) AS early, sum(abs(amount)) AS amount FROM brk WHERE detection_type = 'PROVISIONAL_VARIANCE' GROUP BY ALL) b USING (tenant_bank_id)
 JOIN (SELECT tenant_bank_id, median(s) AS m FROM ({_LATENCY}) WHERE s >= 0 GROUP BY ALL) l USING (tenant_bank_id) JOIN ({_MIX}) x USING (tenant_bank_id)"""
)
def detection_performance(w: Workbench) -> DataFrame:
    rows = dashboards.detection_performance(
        dashboards.coverage(w.events),
        dashboards.early_exposure(w.found_breaks),
        review.review_summary(review.review_counts(w.claim_ids, w.reviews)),
        dashboards.detection_latencies(w.found_issues, w.found_breaks),
        dashboards.new_patterns(w.found_issues, w.found_breaks),
        scoring.pattern_mix(scoring.with_tags(w.banded), w.beneficiaries),
    )
    return rows.select(
        "tenant_bank_id", "provisional_variance_count", "exposure_identified_early", "confirmed_count", "dismissed_count",
        "pending_count", "confirmation_rate", "median_detection_seconds", "known_count", "newly_discovered_count",
    )


@query(
    """SELECT tenant_bank_id, count(*) FILTER (l = 'Critical') AS critical, count(*) FILTER (l = 'High') AS high, count(*) FILTER (l = 'Medium') AS medium, count(*) FILTER (l = 'Low') AS low FROM (
 SELECT tenant_bank_id, CASE anomaly_band WHEN 'Low-Medium' THEN 'Medium' ELSE anomaly_band END AS l FROM banded UNION ALL SELECT tenant_bank_id, priority_level FROM ranked
 UNION ALL SELECT tenant_bank_id, priority_level FROM rbrk) GROUP BY ALL"""
)
def priority_distribution(w: Workbench) -> DataFrame:
    return dashboards.priority_distribution(w.banded, w.ranked_issues, w.ranked_breaks)


@query(
    """, incident AS (SELECT 'operational_issue' AS signal_type, tenant_bank_id, issue_id AS reference_id, CASE WHEN reference_type = 'PARTY' THEN 0 ELSE coalesce(event_count, 0) END AS n, CASE WHEN reference_type = 'PARTY' THEN 0 ELSE coalesce(total_amount, 0) END AS v, 0.0::DOUBLE AS own FROM found
 UNION ALL SELECT 'reconciliation_break', tenant_bank_id, break_id, 1, abs(coalesce(variance_amount, amount)), 0 FROM brk UNION ALL SELECT 'fraud_anomaly', tenant_bank_id, snapshot_id, transaction_count, amount_total, CASE WHEN anomaly_band IN ('High', 'Critical') THEN amount_total ELSE 0 END FROM banded
 UNION ALL SELECT 'funnel_account', tenant_bank_id, snapshot_id, transaction_count, amount_total, 0 FROM ben),
 involved AS (SELECT 'operational_issue' AS signal_type, tenant_bank_id, issue_id AS reference_id, reference_id AS party_id FROM found WHERE reference_type = 'PARTY'
 UNION SELECT 'operational_issue', f.tenant_bank_id, f.issue_id, e.party_id FROM found f JOIN ev e ON e.tenant_bank_id = f.tenant_bank_id AND ((f.reference_type = 'TRANSACTION' AND e.transaction_id = f.reference_id) OR (f.reference_type = 'BATCH' AND e.batch_id = f.reference_id))
 UNION SELECT 'reconciliation_break', tenant_bank_id, break_id, party_id FROM brk UNION SELECT 'fraud_anomaly', tenant_bank_id, snapshot_id, party_id FROM banded),
 pb AS (SELECT tenant_bank_id, party_id, sum(abs(coalesce(variance_amount, amount))) AS b FROM brk GROUP BY ALL), pf AS (SELECT tenant_bank_id, party_id, sum(amount_total) AS f FROM flagged GROUP BY ALL),
 other AS (SELECT signal_type, tenant_bank_id, reference_id, sum(coalesce(b, 0)) AS rec, sum(coalesce(f, 0)) AS fraud FROM involved LEFT JOIN pb USING (tenant_bank_id, party_id) LEFT JOIN pf USING (tenant_bank_id, party_id) GROUP BY ALL),
 totals AS (SELECT tenant_bank_id, count(*) AS all_n, sum(amount) AS all_v, (SELECT sum(abs(coalesce(variance_amount, amount))) FROM brk WHERE brk.tenant_bank_id = ev.tenant_bank_id) AS all_b, (SELECT sum(amount_total) FROM flagged WHERE flagged.tenant_bank_id = ev.tenant_bank_id) AS all_f FROM ev GROUP BY tenant_bank_id)
 SELECT signal_type, tenant_bank_id, reference_id, n AS payments_affected, round_even(least(n / all_n, 1) * 100, 1) AS payments_affected_percent, round_even(v, 2) AS payment_value, round_even(least(v / all_v, 1) * 100, 1) AS payment_value_percent,
 round_even(coalesce(rec, 0), 2) AS reconciliation_exposure, round_even(least(coalesce(rec, 0) / all_b, 1) * 100, 1) AS reconciliation_exposure_percent, round_even(x, 2) AS fraud_exposure, round_even(least(x / all_f, 1) * 100, 1) AS fraud_exposure_percent
 FROM (SELECT *, CASE WHEN signal_type = 'fraud_anomaly' THEN v ELSE 0 END + coalesce(fraud, 0) - own AS x FROM incident LEFT JOIN other USING (signal_type, tenant_bank_id, reference_id) JOIN totals USING (tenant_bank_id))"""
)
def incident_impact(w: Workbench) -> DataFrame:
    return impact.incident_impact(w.events, w.found_issues, w.found_breaks, w.banded, w.beneficiaries)


# --- investigation ------------------------------------------------------------


_CASES = f"""SELECT case_code, tenant_bank_id, category, payment_rail, title, {_r('current_exposure')}, transactions_affected, contributing_alerts_count, {_r('severity_score')}, priority_level, {_iso('opened_at')},
 worst_source_id, 'PENDING' AS validation_status, priority_level || ': ' || lower(worst.a) || ' scored ' || round_even(severity_score, 0)::BIGINT || ' against its peers (' || priority_level || ' starts at ' ||
 CASE priority_level WHEN 'Critical' THEN 85 WHEN 'High' THEN 60 WHEN 'Medium' THEN 35 ELSE 0 END || '), ' ||
 CASE WHEN contributing_alerts_count = 1 THEN 'the only alert' ELSE 'the gravest of ' || contributing_alerts_count || ' alerts' END || ' of this case' AS priority_reason FROM kase"""


@query(_CASES)
def investigation_cases(w: Workbench) -> DataFrame:
    return w.cases


@query(f"SELECT case_code, source_type, source_id, transaction_id, payment_rail, anomaly_type, {_iso('detected_at')} FROM alert")
def case_alerts(w: Workbench) -> DataFrame:
    return w.alerts.select("case_code", "source_type", "source_id", "transaction_id", "payment_rail", "anomaly_type", "detected_at")


@query('SELECT tenant_bank_id, anomaly_type, count(*) AS "count" FROM alert GROUP BY ALL')
def anomaly_type_counts(w: Workbench) -> DataFrame:
    return cases.anomaly_type_counts(w.alerts)


@query(f"SELECT case_code, tenant_bank_id, {_iso('anchor_ts')} FROM kase")
def case_anchor(w: Workbench) -> DataFrame:
    return w.anchored_cases.select("case_code", "tenant_bank_id", "anchor_ts")


@query("SELECT case_code, priority_level FROM kase WHERE tenant_bank_id = 'BANK_0' AND priority_level = 'Critical' AND anchor_ts >= TIMESTAMP '2024-01-01' AND anchor_ts < TIMESTAMP '2024-01-15'")
def case_listing(w: Workbench) -> DataFrame:
    found = listings.cases(w.anchored_cases, "BANK_0", "critical", dt.date(2024, 1, 1), END)
    return found.select("case_code", "priority_level")


@query(f'SELECT tenant_bank_id, category, payment_rail, {_iso("week_start")}, "count" FROM weekly')
def weekly_trend(w: Workbench) -> DataFrame:
    return w.weekly_counts


@query(
    f"SELECT tenant_bank_id, category, payment_rail, weeks_observed, {_iso('latest_week')}, latest_week_count, {_r('prior_weeks_average_count')}, direction FROM trend"
)
def category_trends(w: Workbench) -> DataFrame:
    return w.trends


_PATTERN_TITLE = f"concat_ws(' ', c.payment_rail, CASE c.category WHEN 'FRAUD_HIGH' THEN 'High anomaly cluster' WHEN 'FRAUD_CRITICAL' THEN 'Critical anomaly cluster' ELSE {_LABEL.format('c.category')} END)"
_PAIR = "t.tenant_bank_id = c.tenant_bank_id AND t.category = c.category AND t.payment_rail IS NOT DISTINCT FROM c.payment_rail"


@query(
    f"""SELECT {_PATTERN_TITLE} AS title, representative_case_code, c.tenant_bank_id, c.category, c.payment_rail, direction, round_even((latest_week_count / prior_weeks_average_count - 1) * 100, 0)::BIGINT AS vs_baseline_percent,
 round_even(exposure, 2) AS exposure, CASE worst WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' WHEN 0 THEN 'Low' END AS severity, case_count
 FROM (SELECT tenant_bank_id, category, payment_rail, coalesce(sum(current_exposure), 0) AS exposure, count(*) AS case_count,
 max(CASE priority_level WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 0 ELSE -1 END) AS worst,
 arg_max(case_code, (CASE priority_level WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 0 ELSE -1 END, -epoch_us(opened_at), case_code)) AS representative_case_code FROM kase GROUP BY ALL) c JOIN trend t ON {_PAIR}"""
)
def patterns(w: Workbench) -> DataFrame:
    return trends.patterns(w.cases, w.trends)


@query(
    f"""SELECT tenant_bank_id, case_code, title, {_r('current_exposure')}, priority_level, allowed AS sla_window_days, round_even(age, 1) AS age_days, round_even(allowed - age, 1) AS remaining_days, CASE WHEN allowed - age <= 0 THEN 'overdue' ELSE 'approaching' END AS status
 FROM (SELECT *, CASE priority_level WHEN 'Critical' THEN 2.0 WHEN 'High' THEN 5.0 WHEN 'Low' THEN 20.0 ELSE 10.0 END AS allowed,
 (epoch_us(max(anchor_ts) OVER (PARTITION BY tenant_bank_id)) - epoch_us(anchor_ts)) / 86400000000::DOUBLE AS age FROM kase) WHERE allowed - age <= allowed * 0.3::DOUBLE"""
)
def sla_cases(w: Workbench) -> DataFrame:
    return sla.cases_near_sla(w.anchored_cases)


def _rate_sql(category: str, column: str, flag: str, z: str, kind: str, word: str) -> str:
    peak = f"greatest(max(round_even(h.rate * 100, 2)) OVER (PARTITION BY c.tenant_bank_id, c.case_code), (b.m + {flag} * b.s) * 100)"
    return f"""SELECT '{kind} Rate vs. Expected Baseline' AS title, '%' AS unit, round_even({peak} * 1.25::DOUBLE, 1) AS max_value,
 CASE WHEN abs(h.{z}) >= {flag} THEN printf('{word} rate at |z| = %.1f', round(abs(h.{z}), 1)) END AS annotation, c.tenant_bank_id, c.case_code, strftime(h.window_start::DATE, '%Y-%m-%d') AS point_time, round_even(h.rate * 100, 2) AS point_value,
 round_even(b.m * 100, 2) AS baseline_value, round_even((b.m + {flag} * b.s) * 100, 2) AS threshold_value
 FROM kase c JOIN issue i ON i.issue_id = c.worst_source_id JOIN hist h ON h.tenant_bank_id = c.tenant_bank_id AND h.party_id = i.reference_id AND h.name = '{column}'
 JOIN hist b ON b.tenant_bank_id = c.tenant_bank_id AND b.party_id = i.reference_id AND b.name = '{column}' AND b.window_end = i.window_end
 WHERE c.category = '{category}' AND h.weeks >= 3"""


_HISTORY = """SELECT zt, zf, tenant_bank_id, party_id, window_start, window_end, '{0}' AS name, {0} AS rate, avg({0}) OVER w AS m, coalesce(stddev_samp({0}) OVER w, 0) AS s,
 count(*) OVER (PARTITION BY tenant_bank_id, party_id) AS weeks FROM snap WHERE window_type = 'WEEKLY' AND {0} IS NOT NULL
 WINDOW w AS (PARTITION BY tenant_bank_id, party_id ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(
    f""", hist AS ({_HISTORY.format('timeout_ratio')} UNION ALL {_HISTORY.format('format_reject_ratio')})
 {_rate_sql('NETWORK_TIMEOUT_SPIKE', 'timeout_ratio', '2', 'zt', 'Network Timeout', 'timeout')} UNION ALL {_rate_sql('FORMAT_REJECTION_SPIKE', 'format_reject_ratio', '3', 'zf', 'Format Rejection', 'rejection')}"""
)
def case_rate_trend(w: Workbench) -> DataFrame:
    return trends.case_rate_trend(w.cases, w.snapshots, w.found_issues)


@query(
    f"""SELECT {_PATTERN_TITLE} || ', cases per week' AS title, 'count' AS unit,
 round_even(greatest(max(k."count") OVER (PARTITION BY c.tenant_bank_id, c.case_code), t.prior_weeks_average_count * 1.2::DOUBLE) * 1.25::DOUBLE, 1) AS max_value,
 CASE WHEN k.week_start = t.latest_week AND t.direction <> 'stable' THEN printf('%s from %.1f cases a week', t.direction, t.prior_weeks_average_count) END AS annotation,
 c.tenant_bank_id, c.case_code, strftime(k.week_start::DATE, '%Y-%m-%d') AS point_time, k."count"::DOUBLE AS point_value, round_even(t.prior_weeks_average_count, 2) AS baseline_value,
 round_even(t.prior_weeks_average_count * 1.2::DOUBLE, 2) AS threshold_value FROM kase c JOIN trend t ON {_PAIR} JOIN weekly k ON k.tenant_bank_id = c.tenant_bank_id AND k.category = c.category AND k.payment_rail IS NOT DISTINCT FROM c.payment_rail
 WHERE c.category NOT LIKE '%SPIKE'"""
)
def case_frequency_trend(w: Workbench) -> DataFrame:
    return trends.case_frequency_trend(w.cases, w.weekly_counts, w.trends)


@query(
    """SELECT CASE source_type WHEN 'OPERATIONAL_ISSUE' THEN 'operational_issue' WHEN 'RECONCILIATION_BREAK' THEN 'reconciliation_break' ELSE 'fraud_anomaly' END AS signal_type, tenant_bank_id,
 source_id AS reference_id, CASE WHEN payment_rail IS NULL THEN 'DISMISSED' ELSE 'CONFIRMED' END AS status FROM alert"""
)
def case_validation(w: Workbench) -> DataFrame:
    """Reviews that follow from declaring every case with a rail valid and every other invalid."""
    decisions = w.cases.select(
        "tenant_bank_id",
        "case_code",
        F.when(F.col("payment_rail").isNull(), "INVALID").otherwise("VALID").alias("validation_status"),
        F.lit("analyst").alias("reviewed_by"),
        F.lit(DETECTED_AT).cast("timestamp").alias("acted_at"),
    )
    actions = review.case_validation_actions(decisions, w.alerts)
    return actions.select("signal_type", "tenant_bank_id", "reference_id", "status")


# --- narration ----------------------------------------------------------------


def _facts(w: Workbench) -> DataFrame:
    return narration.finding_facts(w.found_issues, w.found_breaks, w.banded, w.beneficiaries)


def _returned(facts: DataFrame) -> DataFrame:
    """Texts for facts, some of them flawed in the ways the checks look for."""
    kind = F.ascii(F.substring(F.md5("reference_id"), 1, 1)) % 4
    action = F.struct(F.lit("Check").alias("title"), F.lit("Look at it").alias("description"), F.lit("It stands out").alias("why"))
    partial = F.struct(F.lit("Check").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("It stands out").alias("why"))
    actions = F.when(kind == 1, F.array().cast("array<struct<title:string,description:string,why:string>>")).when(
        kind == 2, F.array(partial)
    ).otherwise(F.array(action))
    title = F.concat(F.lit("About "), F.when(kind == 3, F.lit("something")).otherwise(F.col("identifier")))
    content = F.to_json(F.struct(title.alias("title"), F.lit("A finding.").alias("description"), actions.alias("recommended_actions")))
    return facts.select(
        *narration.NARRATIVE_KEY, content.alias("content"), F.lit(DETECTED_AT).cast("timestamp").alias("generated_at")
    )


@query(
    """SELECT signal_type, tenant_bank_id, reference_id, CASE ascii(substr(md5(reference_id), 1, 1)) % 4 WHEN 1 THEN 'needs one to three actions' WHEN 2 THEN 'incomplete action' WHEN 3 THEN 'identifier not named' END AS problem FROM claim_ids"""
)
def narrative_validation(w: Workbench) -> DataFrame:
    facts = _facts(w)
    return narration.validated(_returned(facts), facts).select(*narration.NARRATIVE_KEY, "problem")


@query("SELECT signal_type, tenant_bank_id, reference_id FROM claim_ids WHERE ascii(substr(md5(reference_id), 1, 1)) % 4 <> 0")
def uncached_narratives(w: Workbench) -> DataFrame:
    facts = _facts(w)
    cached = narration.narrative_rows(narration.validated(_returned(facts), facts), "model")
    return narration.uncached(facts, cached).select(*narration.NARRATIVE_KEY)


@query(
    """SELECT signal_type, tenant_bank_id, reference_id, identifier FROM (SELECT 'operational_issue' AS signal_type, tenant_bank_id, issue_id AS reference_id, reference_id AS identifier FROM found
 UNION ALL SELECT 'reconciliation_break', tenant_bank_id, break_id, transaction_id FROM brk UNION ALL SELECT 'fraud_anomaly', tenant_bank_id, snapshot_id, party_id FROM flagged
 UNION ALL SELECT 'funnel_account', tenant_bank_id, snapshot_id, beneficiary_key FROM ben WHERE funnel_drift_score >= 50)"""
)
def finding_facts(w: Workbench) -> DataFrame:
    named = F.get_json_object("facts", "$.signal_type") == F.col("signal_type")
    return _facts(w).filter(named).drop("facts")


@query(
    f"""SELECT 'investigation_case' AS signal_type, c.tenant_bank_id, c.case_code, c.category, c.payment_rail, {_r('current_exposure')}, transactions_affected, contributing_alerts_count,
 {_iso('opened_at')}, t.weeks_observed, t.latest_week_count, round(t.prior_weeks_average_count, 6) AS prior_weeks_average_count, t.direction FROM kase c LEFT JOIN trend t ON {_PAIR}"""
)
def case_facts(w: Workbench) -> DataFrame:
    """Every field of the documents, read back from their text."""
    trend = "category_trend struct<weeks_observed:long, latest_week_count:long, prior_weeks_average_count:double, direction:string>"
    fields = "case_code string, category string, payment_rail string, current_exposure double, transactions_affected long, contributing_alerts_count long"
    read = _read_back(narration.case_facts(w.cases, w.trends), f"{fields}, opened_at string, {trend}")
    return read.select("*", "category_trend.*").drop("category_trend")


@query(f"""SELECT tenant_bank_id, case_code AS reference_id, anomaly_type, CASE source_type WHEN 'OPERATIONAL_ISSUE' THEN 'Operational' WHEN 'RECONCILIATION_BREAK' THEN 'Reconciliation' ELSE 'Fraud' END AS anomaly_category,
 payment_rail, {_iso('detected_at')}, count(*) AS alerts FROM alert GROUP BY ALL""")
def case_alert_facts(w: Workbench) -> DataFrame:
    fields = "anomaly_type string, anomaly_category string, payment_rail string, detected_at string"
    facts = narration.case_alert_facts(w.alerts).select("tenant_bank_id", "reference_id", F.from_json("facts", fields).alias("f"))
    return facts.groupBy("tenant_bank_id", "reference_id", "f").agg(F.count(F.lit(1)).alias("alerts")).select("*", "f.*").drop("f")


def _read_back(facts: DataFrame, fields: str) -> DataFrame:
    """The tenant and the parsed fields of fact documents."""
    parsed = facts.select("tenant_bank_id", F.from_json("facts", f"signal_type string, {fields}").alias("f"))
    return parsed.select("tenant_bank_id", "f.*")


def _documents(w: Workbench, signal: str, fields: str) -> DataFrame:
    return _read_back(_facts(w).filter(F.col("signal_type") == signal), fields)


@query(
    f"""SELECT 'operational_issue' AS signal_type, tenant_bank_id, issue_type, reference_type, reference_id, {_r('severity_score')}, '2024-02-01T00:00:00Z' AS detected_at FROM found"""
)
def issue_documents(w: Workbench) -> DataFrame:
    """Their details are compared by the queries of each type of issue."""
    fields = "issue_type string, reference_type string, reference_id string, severity_score double, detected_at string"
    return _documents(w, "operational_issue", fields)


@query(
    f"""SELECT 'reconciliation_break' AS signal_type, tenant_bank_id, detection_type, transaction_id, rail_type, source_reconciliation_status, {_r('variance_amount', 'amount')}, '2024-02-01T00:00:00Z' AS detected_at FROM brk"""
)
def break_documents(w: Workbench) -> DataFrame:
    names = "detection_type string, transaction_id string, rail_type string, source_reconciliation_status string"
    return _documents(w, "reconciliation_break", f"{names}, variance_amount double, amount double, detected_at string")


_FRAUD_FIELDS = """party_id string, party_type string, window_start string, window_end string, transaction_count long, amount_total double,
 isolation_forest_score double, cluster_changed boolean, timeseries_drift_score double, final_anomaly_score double, anomaly_band string"""
_FRAUD_DOCUMENTS = f"""SELECT 'fraud_anomaly' AS signal_type, tenant_bank_id, party_id, party_type, {_iso('window_start', 'window_end')}, transaction_count,
 {{0}}, {_r('amount_total', 'timeseries_drift_score', 'final_anomaly_score')}, anomaly_band FROM flagged"""


@query(_FRAUD_DOCUMENTS.format("NULL::DOUBLE AS isolation_forest_score, NULL::BOOLEAN AS cluster_changed"))
def fraud_documents(w: Workbench) -> DataFrame:
    return _documents(w, "fraud_anomaly", _FRAUD_FIELDS)


@query(
    f"""SELECT 'funnel_account' AS signal_type, tenant_bank_id, beneficiary_key, beneficiary_name, {_iso('window_start', 'window_end')}, transaction_count, {_r('amount_total')},
 distinct_senders, distinct_new_senders, {_r('new_sender_ratio')}, sender_party_types, {_r('funnel_drift_score')} FROM ben WHERE funnel_drift_score >= 50"""
)
def funnel_documents(w: Workbench) -> DataFrame:
    names = "beneficiary_key string, beneficiary_name string, window_start string, window_end string, transaction_count long, amount_total double"
    senders = "distinct_senders long, distinct_new_senders long, new_sender_ratio double, sender_party_types array<string>, funnel_drift_score double"
    return _documents(w, "funnel_account", f"{names}, {senders}")


# --- a run over the weighted score --------------------------------------------

# Bands of the weighted score of signals that SQL can state; they reach every later table.
_WEIGHTED = f"""SELECT *, {_BAND.format('final_anomaly_score')} AS anomaly_band FROM (SELECT *, forest_score::DOUBLE AS isolation_forest_score,
 0.4::DOUBLE * forest_score + 0.25::DOUBLE * CASE WHEN cluster_changed THEN 100.0 ELSE 0.0 END + 0.35::DOUBLE * coalesce(timeseries_drift_score, 0.0) AS final_anomaly_score FROM {_DERIVED})"""


def _derived_run(w: Workbench) -> Workbench:
    if "derived" not in w.runs:
        w.runs["derived"] = ScoredRun(w, lambda: scoring.with_final_score(_derived_signals(w)))
    return w.runs["derived"]


@query(_HEALTH, banded=_WEIGHTED)
def weighted_health_scores(w: Workbench) -> DataFrame:
    return _health(_derived_run(w)).drop("computed_at")


@query(_BY_DOMAIN.format(""), banded=_WEIGHTED)
def weighted_exposure_by_domain(w: Workbench) -> DataFrame:
    run = _derived_run(w)
    return exposure.exposure_by_domain(run.claims, run.tenants)


@query(_SUMMARY.format(""), banded=_WEIGHTED)
def weighted_review_summary(w: Workbench) -> DataFrame:
    return review_summary(_derived_run(w))


@query(_CASES, banded=_WEIGHTED)
def weighted_investigation_cases(w: Workbench) -> DataFrame:
    return _derived_run(w).cases


@query(_FRAUD_DOCUMENTS.format(_r("isolation_forest_score") + ", cluster_changed"), banded=_WEIGHTED)
def weighted_fraud_documents(w: Workbench) -> DataFrame:
    return _documents(_derived_run(w), "fraud_anomaly", _FRAUD_FIELDS)


@query()
def fully_scored_health(w: Workbench) -> DataFrame:
    """Health over the bands of forest, clusters and drift."""
    return _health(w.fully_scored).drop("computed_at")


@query()
def fully_scored_cases(w: Workbench) -> DataFrame:
    """Cases over the bands of forest, clusters and drift."""
    return w.fully_scored.cases


# --- logs of several runs -----------------------------------------------------

_RUNS = 120
_LATER = dt.timedelta(days=1)


@query(
    f"""SELECT tenant_bank_id, strftime(TIMESTAMP '2024-02-01' + to_days(run::INT), '%Y-%m-%dT%H:%M:%SZ') AS computed_at, health_score, health_band
 FROM ({_HEALTH}), range({_RUNS}) r(run) WHERE run >= {_RUNS} - 90"""
)
def health_history(w: Workbench) -> DataFrame:
    """The last 90 points of a history that grew by one row a day."""
    run = F.explode(F.sequence(F.lit(0), F.lit(_RUNS - 1))).alias("run")
    grown = health.history_rows(_health(w)).select("*", run)
    grown = grown.withColumn("computed_at", F.col("computed_at") + F.make_dt_interval("run")).drop("run")
    return health.health_history(grown)


@query(
    f"""SELECT * REPLACE (CASE WHEN tenant_bank_id = 'BANK_1' THEN health_score ELSE 1.5 END AS health_score),
 CASE WHEN tenant_bank_id = 'BANK_1' THEN '2024-02-01T00:00:00Z' ELSE '2024-02-02T00:00:00Z' END AS computed_at FROM ({_HEALTH})"""
)
def current_health(w: Workbench) -> DataFrame:
    """Of two runs the later one, where a tenant took part in it."""
    first = _health(w)
    later = first.filter("tenant_bank_id <> 'BANK_1'").withColumns(
        {"health_score": F.lit(1.5), "computed_at": F.lit(DETECTED_AT + _LATER).cast("timestamp")}
    )
    return health.current_health(first.unionByName(later))


@query(
    """SELECT signal_type, tenant_bank_id, reference_id, CASE d % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS status,
 CASE d % 3 WHEN 2 THEN 'first' ELSE 'second' END AS reviewed_by, NULL::VARCHAR AS notes,
 CASE d % 3 WHEN 1 THEN '2024-02-02T00:00:00Z' WHEN 2 THEN '2024-02-01T00:00:00Z' END AS reviewed_at
 FROM (SELECT *, ascii(substr(md5(reference_id), 1, 1)) AS d FROM claim_ids)"""
)
def current_reviews(w: Workbench) -> DataFrame:
    """Every claim dismissed by one person; then another sets some pending again and confirms others."""
    kind = F.ascii(F.substring(F.md5("reference_id"), 1, 1)) % 3
    claimed = w.claim_ids.select(*review.REVIEW_KEY, kind.alias("kind"), F.lit(None).cast("string").alias("notes"))

    def acted(rows: DataFrame, status: Column, by: str, at: dt.datetime) -> DataFrame:
        told = {"status": status, "reviewed_by": F.lit(by), "acted_at": F.lit(at).cast("timestamp")}
        return rows.withColumns(told).drop("kind")

    again = F.when(F.col("kind") == 0, "PENDING").otherwise("CONFIRMED")
    log = acted(claimed, F.lit("DISMISSED"), "first", DETECTED_AT).unionByName(
        acted(claimed.filter("kind < 2"), again, "second", DETECTED_AT + _LATER)
    )
    return review.current_reviews(review.review_actions(log))


@query(
    """SELECT signal_type, tenant_bank_id, reference_id, 'About ' || identifier AS title, 'Check' AS recommended_action_title FROM (
 SELECT 'operational_issue' AS signal_type, tenant_bank_id, issue_id AS reference_id, reference_id AS identifier FROM found
 UNION ALL SELECT 'reconciliation_break', tenant_bank_id, break_id, transaction_id FROM brk UNION ALL SELECT 'fraud_anomaly', tenant_bank_id, snapshot_id, party_id FROM flagged
 UNION ALL SELECT 'funnel_account', tenant_bank_id, snapshot_id, beneficiary_key FROM ben WHERE funnel_drift_score >= 50)
 WHERE ascii(substr(md5(reference_id), 1, 1)) % 4 = 0 AND tenant_bank_id = 'BANK_1'"""
)
def narrative_listing(w: Workbench) -> DataFrame:
    """The cache of one tenant after its cases were rebuilt: their texts are gone, all others stay."""
    facts = _facts(w)
    facts = facts.unionByName(narration.case_facts(w.cases, w.trends))
    cached = narration.narrative_rows(narration.validated(_returned(facts), facts), "model")
    kept = narration.list_narratives(narration.without_case_narratives(cached, "BANK_1"), "BANK_1")
    return kept.select(*narration.NARRATIVE_KEY, "title", "recommended_action_title")


@query(
    """SELECT tenant_bank_id, party_type, party_id, count(*) AS transaction_count FROM ev WHERE tenant_bank_id = 'BANK_0' AND party_type = 'MERCHANT' GROUP BY ALL"""
)
def feature_listing(w: Workbench) -> DataFrame:
    found = listings.party_features(parties.party_features(w.events), "BANK_0", "MERCHANT")
    return found.select("tenant_bank_id", "party_type", "party_id", "transaction_count")


@query(
    """SELECT event_ordinal, CASE WHEN k % 11 < 5 THEN true WHEN k % 11 < 10 THEN false END AS spelled,
 CASE k % 3 WHEN 0 THEN 'savings' WHEN 1 THEN 'current' END AS account_type FROM ev"""
)
def spelled_values(w: Workbench) -> DataFrame:
    """Booleans in every spelling and one that is none; account types under either of two names."""
    k = _k(w.events)
    texts = F.array(*map(F.lit, ("TRUE", " 1", "Yes", "y ", "t", "False", "0 ", "NO", " n", "F", "maybe")))
    one, other, neither = (
        F.create_map(F.lit(name), F.lit(value)) for name, value in (("account_type", "savings"), ("entity_account_type", "current"), ("other", "x"))
    )
    flags = F.when(k % 3 == 0, F.map_concat(one, F.create_map(F.lit("entity_account_type"), F.lit("current")))).when(k % 3 == 1, other)
    return w.events.select(
        "event_ordinal",
        to_boolean(F.element_at(texts, k % 11 + 1)).alias("spelled"),
        account_type(flags.otherwise(neither)).alias("account_type"),
    )
