import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import by
from railwatch.operators import cases, health, listings, narration, review, sla, trends

T0 = dt.datetime(2024, 1, 1)
SIGNAL = (
    "tenant_bank_id string, category string, payment_rail string, detected_at timestamp, source_type string, source_id string, "
    "transaction_id string, anomaly_category string, anomaly_type string, description string, exposure double, "
    "severity_score double, priority_level string, party_id string"
)


def signal(number, hours, rail="ACH", category="CONFIRMED_BREAK", score=50.0, level="Medium", exposure=1.0, transaction=True):
    return (
        "BANK", category, rail, T0 + dt.timedelta(hours=hours), "RECONCILIATION_BREAK", f"s{number}",
        f"t{number}" if transaction else None, "Reconciliation", "Confirmed reconciliation break", "", exposure, score, level, "p",
    )


def test_cases_split_on_gaps(spark):
    # 48 h stays together, a second more does not, and rails never mix.
    rows = [signal(0, 0), signal(1, 48, score=90.0, level="Critical"), signal(2, 96.001), signal(3, 97), signal(4, 1, rail=None), signal(5, 2, rail="WIRE")]
    alerts = cases.case_alerts(spark.createDataFrame(rows, SIGNAL))
    assert alerts.count() == 6 and len({r.alert_code for r in alerts.collect()}) == 6
    built = by(cases.investigation_cases(alerts), "payment_rail", "opened_at")
    assert len(built) == 4
    first = built["ACH", T0]
    assert (first["contributing_alerts_count"], first["current_exposure"], first["transactions_affected"]) == (2, 2.0, 2)
    assert (first["priority_level"], first["worst_source_id"]) == ("Critical", "s1")
    assert first["priority_reason"].endswith("scored 90 against its peers (Critical starts at 85), the gravest of 2 alerts of this case")
    assert built[None, T0 + dt.timedelta(hours=1)]["title"] == "Confirmed reconciliation break Cluster"


def test_many_signals_in_one_day_are_one_case(spark):
    rows = [signal(i, i * 0.01, transaction=False) for i in range(300)]
    built = cases.investigation_cases(cases.case_alerts(spark.createDataFrame(rows, SIGNAL))).collect()
    assert [(c.contributing_alerts_count, c.transactions_affected) for c in built] == [(300, 300)]


def test_sla(spark):
    schema = "tenant_bank_id string, case_code string, title string, priority_level string, current_exposure double, validation_status string, anchor_ts timestamp"
    day = dt.timedelta(days=1)
    rows = [
        ("BANK", "new", "", "Critical", 1.0, "PENDING", T0 + 10 * day),
        ("BANK", "due", "", "Critical", 1.0, "PENDING", T0 + 8.5 * day),
        ("BANK", "over", "", "High", 1.0, "PENDING", T0 + 1 * day),
        ("BANK", "long", "", "Low", 1.0, "PENDING", T0 + 1 * day),
        ("BANK", "odd", "", None, 1.0, "PENDING", T0 + 2 * day),
        ("BANK", "shut", "", "High", 1.0, "VALID", T0),
    ]
    got = [(r.case_code, r.status, r.remaining_days) for r in sla.cases_near_sla(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("over", "overdue", -4.0), ("due", "approaching", 0.5), ("odd", "approaching", 2.0)]


@pytest.mark.parametrize("latest, direction", [(13, "increasing"), (12, "stable"), (8, "stable"), (7, "decreasing")])
def test_trend_direction(spark, latest, direction):
    weeks = [("BANK", "DUPLICATE_PAYMENT", "ACH", T0 + dt.timedelta(weeks=i), n) for i, n in enumerate((8, 12, latest))]
    schema = "tenant_bank_id string, category string, payment_rail string, week_start timestamp, count long"
    row = trends.category_trends(spark.createDataFrame(weeks, schema)).first()
    assert (row.prior_weeks_average_count, row.direction, row.weeks_observed) == (10.0, direction, 3)
    assert trends.category_trends(spark.createDataFrame(weeks[:1], schema)).count() == 0


def test_health(spark, make_events):
    events = make_events(*[{"status": "SETTLED" if i < 8 else "FAILED", "reconciliation_status": "MATCHED" if i < 5 else None} for i in range(10)])
    snapshots = spark.createDataFrame([("BANK", "Critical"), ("BANK", "High"), ("BANK", "Normal"), ("BANK", None)], "tenant_bank_id string, anomaly_band string")
    issues, breaks = (spark.createDataFrame([("BANK",)], "tenant_bank_id string") for _ in range(2))
    row = health.health_scores(events, snapshots, issues, breaks, T0).first()
    assert (row.settlement_component, row.anomaly_component, row.operational_component, row.reconciliation_component) == (80.0, 25.0, 90.0, 80.0)
    assert (row.health_score, row.health_band) == (65.5, "At Risk")
    empty = health.health_scores(events, snapshots.limit(0), issues.limit(0), breaks.limit(0), T0).first()
    assert (empty.anomaly_component, empty.health_score) == (100.0, 94.0)


def test_health_history_and_current(spark):
    rows = [("A", T0 + dt.timedelta(days=i), float(i), "Watch") for i in range(5)] + [("B", T0, 9.0, "Watch")]
    log = spark.createDataFrame(rows, "tenant_bank_id string, computed_at timestamp, health_score double, health_band string")
    assert [r.health_score for r in health.health_history(log, 3).collect()] == [2.0, 3.0, 4.0, 9.0]
    assert by(health.current_health(log), "tenant_bank_id")["A"]["health_score"] == 4.0
    assert health.history_rows(log).columns == ["tenant_bank_id", "computed_at", "health_score", "health_band"]


ACTIONS = "signal_type string, tenant_bank_id string, reference_id string, status string, reviewed_by string, notes string, acted_at timestamp"


def act(reference, status, hours, signal_type="operational_issue"):
    return (signal_type, "BANK", reference, status, "me", None, T0 + dt.timedelta(hours=hours))


def test_reviews(spark):
    log = review.review_actions(spark.createDataFrame([act("a", "CONFIRMED", 1), act("a", "PENDING", 2), act("b", "DISMISSED", 3), act("gone", "CONFIRMED", 4)], ACTIONS))
    current = by(review.current_reviews(log), "reference_id")
    assert current["a"]["status"] == "PENDING" and current["a"]["reviewed_at"] is None
    claims = spark.createDataFrame([("operational_issue", "BANK", r) for r in "abc"], "signal_type string, tenant_bank_id string, reference_id string")
    counts = review.review_counts(claims, review.current_reviews(log))
    row = review.review_summary(counts).first()
    assert (row.total_claims, row.confirmed, row.dismissed, row.pending, row.review_rate) == (3, 0, 1, 2, 0.333)
    assert by(review.review_summary_by_type(counts), "signal_type")["funnel_account"]["total_claims"] == 0
    with pytest.raises(Exception, match="unknown review status: MAYBE"):
        review.review_actions(spark.createDataFrame([act("a", "MAYBE", 1)], ACTIONS)).collect()


def test_quality_trend(spark):
    rows = [act("a", "CONFIRMED", 1), act("b", "DISMISSED", 30), act("c", "CONFIRMED", 31), act("d", "CONFIRMED", 24 * 9)]
    reviews = review.current_reviews(review.review_actions(spark.createDataFrame(rows, ACTIONS)))
    points = review.quality_trend(reviews).orderBy("reviewed_count").collect()
    assert [(p.reference_id, p.reviewed_count) for p in points] == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert [round(p.confirmation_rate, 3) for p in points] == [1.0, 0.5, 0.667, 0.75]
    daily = review.quality_trend_daily(reviews, 9).orderBy("date").collect()
    assert [(r.confirmed, r.dismissed) for r in daily] == [(1, 1), (1, 0)]


def test_case_decisions_reach_their_alerts(spark):
    alerts = cases.case_alerts(spark.createDataFrame([signal(0, 0), signal(1, 1)], SIGNAL))
    decision = alerts.select("tenant_bank_id", "case_code").distinct().select("*", F.lit("INVALID").alias("validation_status"), F.lit("me").alias("reviewed_by"), F.lit(T0).alias("acted_at"))
    actions = review.case_validation_actions(decision, alerts).collect()
    assert {(r.signal_type, r.reference_id, r.status) for r in actions} == {("reconciliation_break", "s0", "DISMISSED"), ("reconciliation_break", "s1", "DISMISSED")}


def test_narratives(spark):
    key = ("fraud_anomaly", "BANK")
    facts = spark.createDataFrame([(*key, str(i), "MER-20A7") for i in range(5)], "signal_type string, tenant_bank_id string, reference_id string, identifier string")
    action = '{"title":"t","description":"d","why":"w"}'
    good = f'{{"title":"On MER-20A7","description":"d","recommended_actions":[{action}]}}'
    texts = [good, good.replace("MER-20A7", "MER-20A"), good.replace(action, ""), good.replace(',"why":"w"', ""), "not json"]
    returned = spark.createDataFrame([(*key, str(i), t, T0) for i, t in enumerate(texts)], "signal_type string, tenant_bank_id string, reference_id string, content string, generated_at timestamp")
    checked = narration.validated(returned, facts)
    problems = [r.problem for r in checked.orderBy("reference_id").collect()]
    assert problems == [None, "identifier not named", "needs one to three actions", "incomplete action", "missing required keys"]
    cached = narration.narrative_rows(checked, "m")
    assert cached.first().recommended_action_title == "t"
    assert narration.uncached(facts, cached).count() == 4 and narration.uncached(facts, cached, force=True).count() == 5
    stale = cached.withColumn("signal_type", F.lit("investigation_case"))
    assert narration.without_case_narratives(cached.unionByName(stale), "BANK").count() == 1
    assert narration.list_narratives(cached, "BANK").count() == 1


def test_pages(spark):
    rows = spark.createDataFrame([("BANK", f"{i:02d}", "ACH") for i in range(25)], "tenant_bank_id string, k string, party_type string")
    found = listings.page(listings.party_features(rows, "BANK", "ACH"), [F.desc("k")], 5, 10)
    assert found.total == 25 and [r.k for r in found.rows.collect()] == ["14", "13", "12", "11", "10"]
    assert listings.party_features(rows, "OTHER").count() == 0
