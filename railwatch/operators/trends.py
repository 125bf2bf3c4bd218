"""Weekly counts per category and rail, patterns ranked by change, and case charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.history import earlier_rows, prior_zscore
from railwatch.functions.scalars import pattern_title, week_start
from railwatch.schema import (
    FLAGGED_BANDS,
    FORMAT_REJECTION_SPIKE,
    NETWORK_TIMEOUT_SPIKE,
    SPIKE_ISSUES,
    WEEKLY,
)

MIN_WEEKS = 2
DIRECTION_BAND = 0.2
# Spike category -> (snapshot rate, chart title, |z| that flags it, word in notes).
RATE_CHARTS = {
    NETWORK_TIMEOUT_SPIKE: ("timeout_ratio", "Network Timeout Rate vs. Expected Baseline", 2.0, "timeout"),
    FORMAT_REJECTION_SPIKE: ("format_reject_ratio", "Format Rejection Rate vs. Expected Baseline", 3.0, "rejection"),
}
PRIORITY_ORDER = {"Critical": 3, "High": 2, "Medium": 1, "Low": 0}

_PAIR = ("tenant_bank_id", "category", "payment_rail")


def _weekly_counts(rows: DataFrame, category: Column, rail: Column, when: Column) -> DataFrame:
    return (
        rows.select("tenant_bank_id", category.alias("category"), rail.alias("payment_rail"), when.alias("ts"))
        .filter(F.col("ts").isNotNull())
        .groupBy(*_PAIR, week_start(F.col("ts")).alias("week_start"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def weekly_counts(issues_with_events: DataFrame, breaks_with_events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Findings per category, rail and week of the real event.

    A null rail means all rails. Spikes have no rail, so they only appear there.
    Weeks without a finding are absent.
    """
    rail_of_event = F.col("first_event.rail_type")
    spike = F.col("issue_type").isin(*SPIKE_ISSUES)
    issue_time = F.when(spike, F.col("window_end")).otherwise(F.col("first_event.occurred_ts"))
    flagged = snapshots.filter(F.col("anomaly_band").isin(*FLAGGED_BANDS))
    fraud_category = F.concat(F.lit("FRAUD_"), F.upper("anomaly_band"))
    only_rail = F.when(F.size("rails_used") == 1, F.try_element_at("rails_used", F.lit(1)))
    per_rail = reduce(
        DataFrame.unionByName,
        [
            _weekly_counts(issues_with_events, F.col("issue_type"), rail_of_event, issue_time),
            _weekly_counts(breaks_with_events, F.col("detection_type"), F.col("rail_type"), F.col("occurred_ts")),
            _weekly_counts(flagged, fraud_category, only_rail, F.col("window_end")),
        ],
    )
    every_rail = per_rail.groupBy("tenant_bank_id", "category", "week_start").agg(F.sum("count").alias("count"))
    return per_rail.filter(F.col("payment_rail").isNotNull()).unionByName(
        every_rail.withColumn("payment_rail", F.lit(None).cast("string"))
    )


def category_trends(counts: DataFrame) -> DataFrame:
    """Latest week against the mean of the earlier ones; at least two weeks are needed."""
    totals = counts.groupBy(*_PAIR).agg(
        F.count(F.lit(1)).alias("weeks_observed"),
        F.max_by("count", "week_start").alias("latest_week_count"),
        F.max("week_start").alias("latest_week"),
        F.sum("count").alias("all_count"),
    )
    latest, weeks = F.col("latest_week_count"), F.col("weeks_observed")
    prior_mean = (F.col("all_count") - latest) / (weeks - 1)
    direction = (
        F.when(latest > prior_mean * (1 + DIRECTION_BAND), "increasing")
        .when(latest < prior_mean * (1 - DIRECTION_BAND), "decreasing")
        .otherwise("stable")
    )
    return totals.filter(weeks >= MIN_WEEKS).select(
        *_PAIR,
        "weeks_observed",
        "latest_week",
        "latest_week_count",
        F.bround(prior_mean, 1).alias("prior_weeks_average_count"),
        direction.alias("direction"),
    )


def _with_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on tenant, category and rail, where a null rail matches a null rail."""
    keyed = right.withColumnRenamed("payment_rail", "__rail")
    joined = left.join(
        keyed.withColumnsRenamed({"tenant_bank_id": "__tenant", "category": "__category"}),
        (F.col("tenant_bank_id") == F.col("__tenant"))
        & (F.col("category") == F.col("__category"))
        & F.col("payment_rail").eqNullSafe(F.col("__rail")),
    )
    return joined.drop("__tenant", "__category", "__rail")


def patterns(cases: DataFrame, trends: DataFrame) -> DataFrame:
    """Category and rail pairs with a trend, the strongest change first."""
    rank = F.lit(-1)
    for name, value in PRIORITY_ORDER.items():
        rank = F.when(F.col("priority_level") == name, F.lit(value)).otherwise(rank)
    grouped = cases.groupBy(*_PAIR).agg(
        F.bround(F.coalesce(F.sum("current_exposure"), F.lit(0.0)), 2).alias("exposure"),
        F.count(F.lit(1)).alias("case_count"),
        F.max_by(
            F.struct("priority_level", "case_code"),
            F.struct(rank.alias("rank"), (-F.unix_micros("opened_at")).alias("earliest"), F.col("case_code")),
        ).alias("worst"),
    )
    change = F.bround((F.col("latest_week_count") / F.col("prior_weeks_average_count") - 1) * 100, 0)
    return (
        _with_pair(grouped, trends)
        .select(
            pattern_title(F.col("category"), F.col("payment_rail")).alias("title"),
            *_PAIR,
            "direction",
            change.cast("long").alias("vs_baseline_percent"),
            "exposure",
            F.col("worst.priority_level").alias("severity"),
            "case_count",
            F.col("worst.case_code").alias("representative_case_code"),
        )
        .orderBy("tenant_bank_id", F.desc(F.abs("vs_baseline_percent")), "title")
    )


def case_frequency_trend(cases: DataFrame, counts: DataFrame, trends: DataFrame) -> DataFrame:
    """Weekly points of every case without a rate of its own, with baseline and threshold."""
    plain = cases.filter(~F.col("category").isin(*RATE_CHARTS)).select("case_code", *_PAIR)
    drawn = _with_pair(_with_pair(plain, trends), counts)
    baseline = F.col("prior_weeks_average_count")
    threshold = baseline * (1 + DIRECTION_BAND)
    case = Window.partitionBy("tenant_bank_id", "case_code")
    peak = F.greatest(F.max("count").over(case).cast("double"), threshold)
    note = F.when(
        (F.col("week_start") == F.col("latest_week")) & F.col("direction").isin("increasing", "decreasing"),
        F.format_string("%s from %.1f cases a week", "direction", baseline),
    )
    return drawn.select(
        "tenant_bank_id",
        "case_code",
        F.concat(pattern_title(F.col("category"), F.col("payment_rail")), F.lit(", cases per week")).alias("title"),
        F.lit("count").alias("unit"),
        F.to_date("week_start").alias("point_time"),
        F.col("count").cast("double").alias("point_value"),
        F.bround(baseline, 2).alias("baseline_value"),
        F.bround(threshold, 2).alias("threshold_value"),
        F.bround(peak * 1.25, 1).alias("max_value"),
        note.alias("annotation"),
    )


def case_rate_trend(cases: DataFrame, snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    """Weekly rate of the party behind each spike case's worst alert, in percent.

    Baseline and threshold come from the weeks before the alert's own week, or
    before the latest week where that one is gone. Below three weeks there is
    no chart.
    """
    return reduce(
        DataFrame.unionByName,
        [_rate_chart(category, cases, snapshots, issues) for category in RATE_CHARTS],
    )


def _rate_chart(category: str, cases: DataFrame, snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    rate_column, title, flag_z, word = RATE_CHARTS[category]
    rate = F.col("rate")
    weeks = snapshots.filter((F.col("window_type") == WEEKLY) & F.col(rate_column).isNotNull()).select(
        "tenant_bank_id", "party_id", "window_start", "window_end", F.col(rate_column).alias("rate")
    )
    keys = ["tenant_bank_id", "party_id"]
    earlier = earlier_rows(keys, "window_start")
    history = weeks.select(
        "*",
        prior_zscore(rate, earlier).alias("z"),
        F.avg(rate).over(earlier).alias("prior_mean"),
        F.coalesce(F.stddev_samp(rate).over(earlier), F.lit(0.0)).alias("prior_std"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("party_weeks"),
        F.max("window_start").over(Window.partitionBy(*keys)).alias("last_week"),
    ).filter(F.col("party_weeks") >= 3)

    worst = issues.select(
        "tenant_bank_id",
        F.col("issue_id").alias("worst_source_id"),
        F.col("reference_id").alias("party_id"),
        F.col("window_end").alias("trigger_end"),
    )
    spiked = (
        cases.filter(F.col("category") == category)
        .select("tenant_bank_id", "case_code", "worst_source_id")
        .join(worst, ["tenant_bank_id", "worst_source_id"])
    )
    points = spiked.join(history, keys)
    case = Window.partitionBy("tenant_bank_id", "case_code")
    limit = F.struct(
        (F.col("prior_mean") * 100).alias("baseline"),
        ((F.col("prior_mean") + flag_z * F.col("prior_std")) * 100).alias("threshold"),
    )
    at_trigger = F.max(F.when((F.col("window_end") == F.col("trigger_end")) & F.col("prior_mean").isNotNull(), limit)).over(case)
    at_last = F.max(F.when(F.col("window_start") == F.col("last_week"), limit)).over(case)
    percent = F.bround(rate * 100, 2)
    drawn = points.withColumn("limit", F.coalesce(at_trigger, at_last)).withColumn("percent", percent)
    peak = F.greatest(F.max("percent").over(case), F.col("limit.threshold"))
    note = F.when(
        F.abs("z") >= flag_z,
        F.format_string(f"{word} rate at |z| = %.1f", F.abs("z")),
    )
    return drawn.select(
        "tenant_bank_id",
        "case_code",
        F.lit(title).alias("title"),
        F.lit("%").alias("unit"),
        F.to_date("window_start").alias("point_time"),
        F.col("percent").alias("point_value"),
        F.bround("limit.baseline", 2).alias("baseline_value"),
        F.bround("limit.threshold", 2).alias("threshold_value"),
        F.bround(peak * 1.25, 1).alias("max_value"),
        note.alias("annotation"),
    )
