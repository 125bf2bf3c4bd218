import datetime as dt

import pytest

from conftest import by
from railwatch.operators import drift, snapshots

MONDAY = dt.datetime(2024, 1, 1)


def at(week, day=0, hour=10):
    return (MONDAY + dt.timedelta(weeks=week, days=day, hours=hour)).strftime("%Y-%m-%dT%H:%M:%SZ")


def busy(party="MER-1", weeks=5, per_week=4, amounts=lambda week, i: 100.0, **extra):
    return [
        {"merchant_id": party, "amount": amounts(w, i), "payee_name": f"P{i % 3}", "transaction_occurred_at": at(w, i % 6), **extra}
        for w in range(weeks)
        for i in range(per_week)
    ]


def test_weekly_and_to_date_rows(make_events):
    events = make_events(
        *busy(),
        {"individual_id": "IND-1", "amount": 5.0, "transaction_occurred_at": at(0)},
        {"individual_id": "IND-1", "amount": 7.0, "transaction_occurred_at": at(2)},
        {"merchant_id": "MER-SMALL", "amount": None, "transaction_occurred_at": at(1)},
        {"merchant_id": "MER-1", "amount": 1.0, "transaction_occurred_at": "not a time"},
        {"merchant_id": "MER-1", "amount": 1.0, "transaction_occurred_at": None},
    )
    rows = snapshots.entity_snapshots(events).collect()
    weekly = [r for r in rows if r.party_id == "MER-1"]
    assert len(weekly) == 5 and all(r.window_type == "WEEKLY" and r.transaction_count == 4 for r in weekly)
    assert all(r.new_counterparty_ratio == 0.75 and r.unique_counterparties == 3 for r in weekly)
    assert {r.split for r in weekly} == {"train", "test"}
    person = next(r for r in rows if r.party_id == "IND-1")
    assert (person.window_type, person.window_start, person.split) == ("TO_DATE", None, "train")
    assert (person.amount_median, person.amount_total, person.account_age_days) == (6.0, 12.0, 14.0)
    assert person.amount_std == pytest.approx(2**0.5)
    small = next(r for r in rows if r.party_id == "MER-SMALL")
    assert (small.amount_total, small.amount_std, small.near_threshold_ratio, small.unique_counterparties) == (None, None, None, None)
    left_out = snapshots.undated_count(events).first()
    assert (left_out.skipped_no_timestamp, left_out.skipped_unreadable) == (1, 1)


def test_large_windows_take_the_ranked_median(make_events):
    events = make_events(*busy(amounts=lambda w, i: float((i * 37 + w * 11) % 23)))
    plain = by(snapshots.entity_snapshots(events), "snapshot_id")
    ranked = by(snapshots.entity_snapshots(events, hot_window_rows=1), "snapshot_id")
    assert plain == ranked


def test_many_low_volume_merchants_are_joined_by_salt(make_events, monkeypatch):
    events = make_events(*busy(), *busy("MER-2", weeks=2), *busy("MER-3", weeks=1))
    plain = by(snapshots.entity_snapshots(events), "snapshot_id")
    monkeypatch.setattr(snapshots, "BROADCAST_ROWS", 0)
    assert by(snapshots.entity_snapshots(events), "snapshot_id") == plain
    assert {r["window_type"] for r in plain.values()} == {"WEEKLY", "TO_DATE"}


def test_risk_verdicts_do_not_leak(make_events):
    quiet = by(snapshots.entity_snapshots(make_events(*busy())), "snapshot_id")
    flagged = make_events(*busy(new_payee_risk_flag=True, structuring_flag=True, fraud_risk_details={"velocity_score": "9"}))
    assert by(snapshots.entity_snapshots(flagged), "snapshot_id") == quiet


def test_response_times_and_thresholds(make_events):
    def response(ms, sla):
        return {"network_response_control.response_time_ms": ms, "network_response_control.expected_response_sla_ms": sla}

    base = {"individual_id": "I", "transaction_occurred_at": at(0)}
    events = make_events(
        {**base, "amount": 9000.0, "network_response_details": response("100", "50")},
        {**base, "amount": 10000.0, "network_response_details": response("40", "50")},
        {**base, "amount": 9999.99, "network_response_details": response("slow", "50"), "format_validation_status": ""},
        {**base, "amount": 1.0, "format_validation_status": "FAILED"},
    )
    row = snapshots.entity_snapshots(events).first()
    assert (row.avg_response_time_ms, row.timeout_ratio, row.near_threshold_ratio, row.format_reject_ratio) == (70.0, 0.5, 0.5, 1.0)


def test_beneficiaries(make_events):
    def pay(week, sender, name="Acme", **extra):
        return {"payee_name": name, "payee_account_ref": "****1", "merchant_id": sender, "amount": 1.0, "transaction_occurred_at": at(week), **extra}

    events = make_events(
        pay(0, "A"), pay(0, "A"), pay(1, "A"), pay(1, "B", name="Acme Ltd"), pay(3, "B"),
        pay(1, "A", tenant_bank_id="OTHER"),
        {"payee_name": "Cash", "payer_name": "Walk-in", "transaction_occurred_at": at(0)},
        {"payee_name": None, "transaction_occurred_at": at(0)},
    )
    rows = by(snapshots.beneficiary_snapshots(events), "tenant_bank_id", "beneficiary_key", "window_start")
    weeks = [rows["BANK", "****1", MONDAY + dt.timedelta(weeks=w)] for w in (0, 1, 3)]
    assert [(r["transaction_count"], r["distinct_senders"], r["distinct_new_senders"]) for r in weeks] == [(2, 1, 1), (2, 2, 1), (1, 1, 0)]
    assert weeks[1]["beneficiary_name"] == "Acme Ltd"
    assert rows["OTHER", "****1", MONDAY + dt.timedelta(weeks=1)]["distinct_new_senders"] == 1
    cash = rows["BANK", "Cash", MONDAY]
    assert (cash["distinct_senders"], cash["sender_party_types"], cash["amount_total"]) == (1, [], None)
    assert len(rows) == 5


@pytest.mark.parametrize("last, expected", [(1000.0, 0.0), (50000.0, pytest.approx(100 / 3))])
def test_drift_needs_two_weeks_and_sees_a_jump(make_events, last, expected):
    events = make_events(*busy(amounts=lambda w, i: last if w == 4 else 1000.0))
    scored = drift.with_merchant_drift(snapshots.entity_snapshots(events)).orderBy("window_start").collect()
    assert [r.timeseries_drift_score for r in scored[:4]] == [None, None, 0.0, 0.0]
    assert scored[4].timeseries_drift_score == expected
