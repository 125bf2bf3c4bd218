"""Behavioural snapshots of senders and of beneficiaries.

Only amounts, times, payees, rails, retry flags, network responses and format
results are read here; the source's own risk verdicts never are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.functions.joins import join_small
from railwatch.functions.scalars import iso_text, local_week_start, map_value_by_suffix, non_empty, parse_iso
from railwatch.operators.parties import PARTY_KEY, party_id, party_type, share_status, share_true, with_party
from railwatch.schema import INDIVIDUAL, MERCHANT, TO_DATE, WEEKLY
from railwatch.session import stored

MIN_WEEKLY_EVENTS = 15
TEST_HOLDOUT = 0.2
MIN_SPLIT_EVENTS = 5
NEAR_THRESHOLD = (9000.0, 10000.0)

# A window with more rows than this gets its median from the ranked buckets
# instead of one aggregation buffer. At most rows/HOT_WINDOW_ROWS windows can
# be that large, which bounds the table that is broadcast below.
HOT_WINDOW_ROWS = 1_000_000

# Low-volume merchants are broadcast up to this count and joined by salt beyond it.
BROADCAST_ROWS = 500_000
SALTS = 64


def dated_party_events(events: DataFrame) -> DataFrame:
    """Events of resolved parties whose time can be read."""
    resolved = with_party(events).filter(F.col("party_id").isNotNull())
    timed = resolved.withColumn("occurred_ts", parse_iso(F.col("transaction_occurred_at")))
    return timed.filter(F.col("occurred_ts").isNotNull()).withColumn(
        "week_start", local_week_start(F.col("transaction_occurred_at"))
    )


def undated_count(events: DataFrame) -> DataFrame:
    """Resolved events per tenant that snapshots leave out: those without a time, and those whose time cannot be read."""
    resolved = with_party(events).filter(F.col("party_id").isNotNull())
    missing = F.col("transaction_occurred_at").isNull()
    unreadable = ~missing & parse_iso(F.col("transaction_occurred_at")).isNull()
    return (
        resolved.groupBy("tenant_bank_id")
        .agg(F.count_if(missing).alias("skipped_no_timestamp"), F.count_if(unreadable).alias("skipped_unreadable"))
        .filter("skipped_no_timestamp > 0 or skipped_unreadable > 0")
    )


def split_cutoffs(dated: DataFrame, holdout: float = TEST_HOLDOUT) -> DataFrame:
    """Per tenant, the instant that starts the held-out tail; none below five events."""
    levels = ranks.instant_levels(F.col("occurred_ts"))
    return ranks.at_index_fraction(
        dated, ["tenant_bank_id"], "occurred_ts", 1 - holdout, "cutoff", levels, min_rows=MIN_SPLIT_EVENTS
    )


def party_weeks(dated: DataFrame) -> DataFrame:
    """Event counts and first and last times per party and week."""
    return dated.groupBy(*PARTY_KEY, "week_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("occurred_ts").alias("first_ts"), F.max("occurred_ts").alias("last_ts")
    )


def _windowed(df: DataFrame, low_volume: DataFrame, low_count: int, salt_by: str) -> DataFrame:
    """Add the window of each row: its week for an active merchant, else the whole history.

    Low-volume merchants are marked by a broadcast while they are few. Beyond
    that both sides are salted, so a party with a third of all events still
    spreads over many tasks.
    """
    if low_count == 0:
        marked = df.withColumn("low_volume", F.lit(None).cast("boolean"))
    elif low_count <= BROADCAST_ROWS:
        marked = df.join(F.broadcast(low_volume), list(PARTY_KEY), "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        dealt = df.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
        marked = dealt.join(low_volume.select("*", salts), [*PARTY_KEY, "salt"], "left").drop("salt")
    weekly = (F.col("party_type") == MERCHANT) & F.col("low_volume").isNull()
    typed = marked.withColumn("window_type", F.when(weekly, WEEKLY).otherwise(TO_DATE))
    windowed = typed.withColumn("window_start", F.when(weekly, F.col("week_start")))
    return windowed.withColumn("window_id", _window_id()).drop("low_volume")


def entity_snapshots(
    events: DataFrame, min_weekly_events: int = MIN_WEEKLY_EVENTS, hot_window_rows: int = HOT_WINDOW_ROWS
) -> DataFrame:
    """Weekly rows for active merchants, one to-date row for every other party."""
    dated = dated_party_events(events)
    weekly = stored(party_weeks(dated), "party_weeks")
    profiles = weekly.groupBy(*PARTY_KEY).agg(
        F.sum("n").alias("party_rows"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen")
    )
    low_volume = profiles.filter(
        (F.col("party_type") == MERCHANT) & (F.col("party_rows") < min_weekly_events)
    ).select(*PARTY_KEY, F.lit(True).alias("low_volume"))
    low_count = low_volume.count()
    windowed = _windowed(dated, low_volume, low_count, "transaction_id")

    window = [*PARTY_KEY, "window_type", "window_id"]
    sizes = _windowed(weekly, low_volume, low_count, "week_start").groupBy(*window).agg(F.sum("n").alias("n"))
    hot = sizes.filter(F.col("n") > hot_window_rows).select(*window, F.lit(True).alias("hot"))
    if hot.isEmpty():
        marked = windowed.withColumn("hot", F.lit(None).cast("boolean"))
        hot_medians = None
    else:
        marked = join_small(windowed, hot, window, "left")
        hot_medians = ranks.median(marked.filter("hot"), window, "amount", "hot_median")
    features = marked.groupBy(*window, "window_start").agg(*_window_features())
    combined = features.join(marked.groupBy(*window).agg(*_collected_features()), window)
    if hot_medians is not None:
        combined = combined.join(hot_medians, window, "left").withColumn(
            "amount_median", F.coalesce("hot_median", "amount_median")
        )
    combined = combined.join(profiles, list(PARTY_KEY))
    combined = join_small(combined, split_cutoffs(dated), ["tenant_bank_id"], "left")
    weekly_row = F.col("window_type") == WEEKLY
    window_end = F.when(weekly_row, F.col("window_start") + F.expr("INTERVAL 7 DAYS")).otherwise(F.col("last_seen"))
    held_out = weekly_row & (F.col("window_start") >= F.col("cutoff"))
    finished = combined.withColumn("window_end", window_end).select(
        F.concat_ws("|", "tenant_bank_id", "party_id", "window_type", "window_id").alias("snapshot_id"),
        "tenant_bank_id",
        "party_id",
        "party_type",
        F.col("party_type").alias("segment"),
        "window_type",
        "window_start",
        "window_end",
        "transaction_count",
        "amount_total",
        "amount_avg",
        "amount_median",
        "amount_std",
        "unique_counterparties",
        "new_counterparty_ratio",
        "retry_ratio",
        "avg_response_time_ms",
        "timeout_ratio",
        "format_reject_ratio",
        "near_threshold_ratio",
        "rails_used",
        ((F.unix_micros("window_end") - F.unix_micros("first_seen")) / 86_400_000_000).alias("account_age_days"),
        F.when(held_out, "test").otherwise("train").alias("split"),
    )
    return finished


def _window_id() -> Column:
    return F.coalesce(iso_text(F.col("window_start")), F.lit(TO_DATE)).alias("window_id")


def _window_features() -> Sequence[Column]:
    amount = F.col("amount")
    payee = non_empty(F.col("payee_name"))
    response = map_value_by_suffix(F.col("network_response_details"), ".response_time_ms").try_cast("double")
    allowed = map_value_by_suffix(F.col("network_response_details"), ".expected_response_sla_ms").try_cast("double")
    low, high = NEAR_THRESHOLD
    distinct_payees = F.count_distinct(payee)
    return [
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(amount).alias("amount_total"),
        F.avg(amount).alias("amount_avg"),
        F.when(F.count(amount) == 1, 0.0).otherwise(F.stddev_samp(amount)).alias("amount_std"),
        F.when(distinct_payees > 0, distinct_payees).alias("unique_counterparties"),
        F.try_divide(distinct_payees, F.count(payee)).alias("new_counterparty_ratio"),
        share_true(F.col("is_retry")).alias("retry_ratio"),
        F.avg(response).alias("avg_response_time_ms"),
        F.avg((response > allowed).cast("double")).alias("timeout_ratio"),
        share_status(non_empty(F.col("format_validation_status")), "FAILED").alias("format_reject_ratio"),
        F.avg(((amount >= low) & (amount < high)).cast("double")).alias("near_threshold_ratio"),
    ]


def _collected_features() -> Sequence[Column]:
    """Features whose buffers hold values. They are kept apart from the distinct
    count, which would otherwise carry one such buffer per payee."""
    return [
        F.median(F.when(F.col("hot").isNull(), F.col("amount"))).alias("amount_median"),
        F.array_sort(F.collect_set("rail_type")).alias("rails_used"),
    ]


def beneficiary_snapshots(events: DataFrame) -> DataFrame:
    """One row per payee and week with the senders seen, and those never seen before.

    Rows are combined per sender first, so a payee that receives a third of all
    payments reaches the last step as one row per sender and week.
    """
    payee = F.col("payee_name")
    paid = events.filter(payee.isNotNull()).select(
        "tenant_bank_id",
        F.coalesce(non_empty(F.col("payee_account_ref")), payee).alias("beneficiary_key"),
        F.coalesce(party_id(), F.col("payer_name")).alias("sender"),
        party_type().alias("sender_type"),
        non_empty(payee).alias("name"),
        "amount",
        "event_ordinal",
        parse_iso(F.col("transaction_occurred_at")).alias("occurred_ts"),
        local_week_start(F.col("transaction_occurred_at")).alias("window_start"),
    )
    key = ["tenant_bank_id", "beneficiary_key"]
    named_at = F.struct("occurred_ts", "event_ordinal", "name")
    per_sender = (
        paid.filter(F.col("occurred_ts").isNotNull())
        .groupBy(*key, "window_start", "sender")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("amount").alias("amount"),
            F.max(F.when(F.col("name").isNotNull(), named_at)).alias("latest"),
            F.bool_or(F.col("sender_type") == MERCHANT).alias("has_merchant"),
            F.bool_or(F.col("sender_type") == INDIVIDUAL).alias("has_individual"),
        )
    )
    ever = Window.partitionBy(*key, "sender")
    sighted = per_sender.withColumn("first_week", F.min("window_start").over(ever))
    is_new = F.col("sender").isNotNull() & (F.col("first_week") == F.col("window_start"))
    weekly = sighted.groupBy(*key, "window_start").agg(
        F.sum("n").alias("transaction_count"),
        F.sum("amount").alias("amount_total"),
        F.count("sender").alias("distinct_senders"),
        F.count_if(is_new).alias("distinct_new_senders"),
        F.max("latest").getField("name").alias("beneficiary_name"),
        F.bool_or("has_merchant").alias("has_merchant"),
        F.bool_or("has_individual").alias("has_individual"),
    )
    types = F.array_compact(
        F.array(F.when(F.col("has_individual"), INDIVIDUAL), F.when(F.col("has_merchant"), MERCHANT))
    )
    return weekly.select(
        F.concat_ws("|", "tenant_bank_id", "beneficiary_key", iso_text(F.col("window_start"))).alias("snapshot_id"),
        *key,
        "beneficiary_name",
        "window_start",
        (F.col("window_start") + F.expr("INTERVAL 7 DAYS")).alias("window_end"),
        "transaction_count",
        "amount_total",
        "distinct_senders",
        "distinct_new_senders",
        F.when(
            F.col("distinct_senders") > 0, F.col("distinct_new_senders") / F.col("distinct_senders")
        ).alias("new_sender_ratio"),
        types.alias("sender_party_types"),
    )
