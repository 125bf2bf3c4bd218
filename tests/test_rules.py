import datetime as dt

import pytest

from conftest import by
from railwatch.operators import operations, priority, reconciliation, snapshots
from test_snapshots import at, busy

AS_OF = dt.datetime(2024, 1, 20, 12, tzinfo=dt.timezone.utc)
NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def test_duplicates_need_two_settled(make_events):
    events = make_events(
        {"idempotency_key": "K1", "status": "SETTLED"},
        {"idempotency_key": "K1", "status": "SETTLED"},
        {"idempotency_key": "K2", "status": "SETTLED"},
        {"idempotency_key": "K2", "status": "FAILED"},
        {"idempotency_key": "", "status": "SETTLED"},
        {"idempotency_key": "", "status": "SETTLED"},
        {"idempotency_key": "K1", "status": "SETTLED", "tenant_bank_id": "OTHER"},
    )
    found = by(operations.duplicate_payments(events, NOW), "issue_id")
    assert list(found) == ["DUPLICATE_PAYMENT|BANK|K1"]
    assert found["DUPLICATE_PAYMENT|BANK|K1"]["reference_id"] == "T0"
    members = operations.duplicate_members(events).collect()
    assert {(r.link_key, r.transaction_id, r.is_settled) for r in members} == {("K1", "T0", True), ("K1", "T1", True)}


def test_retry_links(make_events):
    retry = {"is_retry": True, "status": "SETTLED"}
    events = make_events(
        {"transaction_id": "A", "status": "SETTLED"},
        {"transaction_id": "A2", "original_transaction_id": "A", **retry, "status": "FAILED"},
        {"transaction_id": "A3", "original_transaction_id": "A", **retry},
        {"transaction_id": "B", "idempotency_key": "K", "status": "SETTLED"},
        {"transaction_id": "B2", "idempotency_key": "K", "original_transaction_id": "B", **retry},
        {"transaction_id": "C2", "original_transaction_id": "GONE", **retry},
        {"transaction_id": "D", "original_transaction_id": "D", **retry},
    )
    links = by(operations.retry_link_duplicates(events, NOW), "issue_id")
    # The first retry failed, so the original is the first settled member.
    assert {k: v["reference_id"] for k, v in links.items()} == {"DUPLICATE_PAYMENT|BANK|RETRY-LINK:A": "A"}
    assert {r.transaction_id for r in operations.duplicate_members(events).filter("link_key LIKE 'RETRY%'").collect()} == {"A", "A2", "A3"}
    assert set(by(operations.duplicate_payments(events, NOW), "reference_id")) == {"A", "B"}


def test_unsettled_batches(make_events):
    due, later = "2024-01-18T00:00:00Z", "2024-01-25T00:00:00Z"
    batch = lambda b, **row: {"batch_id": b, "file_reached_settlement": True, "expected_settlement_at": due, **row}
    events = make_events(
        batch("LATE", expected_settlement_at="unknown"), batch("LATE"), batch("LATE", file_reached_settlement=None),
        batch("DONE"), batch("EARLY", expected_settlement_at=later, file_reached_settlement=False),
        batch("OPEN", expected_settlement_at=None, file_reached_settlement=False),
        batch("LATE", tenant_bank_id="OTHER"),
    )
    found = by(operations.unsettled_batches(events, AS_OF, NOW), "issue_id")
    assert {k: v["days_overdue"] for k, v in found.items()} == {"BATCH_NOT_SETTLED|BANK|LATE": 2}


def test_rejections_and_breaks(make_events):
    events = make_events(
        {"format_validation_status": "FAILED", "reconciliation_status": "BREAK", "reconciliation_variance_amount": 0.0, "amount": 5.0},
        {"format_validation_status": "PASSED", "reconciliation_status": "MATCHED", "reconciliation_variance_amount": -2.0},
        {"reconciliation_status": None, "reconciliation_variance_amount": 9.0},
        {"reconciliation_status": "MATCHED", "reconciliation_variance_amount": 0.0},
    )
    assert [r.reference_id for r in operations.format_rejections(events, NOW).collect()] == ["T0"]
    breaks = by(reconciliation.reconciliation_breaks(events, NOW), "transaction_id")
    assert {k: v["detection_type"] for k, v in breaks.items()} == {"T0": "CONFIRMED_BREAK", "T1": "PROVISIONAL_VARIANCE"}
    ranked = by(priority.with_break_priority(reconciliation.reconciliation_breaks(events, NOW)), "transaction_id")
    # T0 has no variance, so its amount sizes it; it is the larger of the two.
    assert ranked["T0"]["priority_score"] == 100.0 and ranked["T1"]["priority_score"] == 50.0
    assert ranked["T1"]["priority_level"] == "Medium"


def test_confirmed_breaks_never_rank_low(make_events):
    rows = [{"reconciliation_status": "BREAK", "amount": float(i + 1)} for i in range(10)]
    ranked = by(priority.with_break_priority(reconciliation.reconciliation_breaks(make_events(*rows), NOW)), "transaction_id")
    assert ranked["T0"]["priority_score"] == 50.0 and ranked["T9"]["priority_level"] == "Critical"


def test_spikes(make_events):
    def slow(week, i):
        late = week == 4 or (week == 3 and i == 0) or (week == 1 and i == 1)
        return {"x.response_time_ms": "900" if late else "10", "x.expected_response_sla_ms": "100"}

    rows = busy()
    for number, row in enumerate(rows):
        week, i = divmod(number, 4)
        row["network_response_details"] = slow(week, i)
        row["format_validation_status"] = "FAILED" if week == 4 else "PASSED"
    table = snapshots.entity_snapshots(make_events(*rows))
    timeout = operations.timeout_spikes(table, NOW).collect()
    assert [r.window_start for r in timeout] == [dt.datetime(2024, 1, 29)]
    assert timeout[0].severity_score == 100.0
    # A jump from an unbroken zero counts as five deviations.
    spikes = operations.format_rejection_spikes(table, NOW).collect()
    assert [(r.reference_id, r.severity_score) for r in spikes] == [("MER-1", 100.0)]


def test_issue_priority(make_events):
    rows = [{"format_validation_status": "FAILED", "amount": float(a), "transaction_occurred_at": at(0)} for a in (1, 2, 3, 4)]
    rows.append({"format_validation_status": "FAILED", "amount": None})
    events = make_events(*rows)
    ranked = by(priority.with_issue_priority(operations.format_rejections(events, NOW), events), "reference_id")
    assert [ranked[f"T{i}"]["priority_score"] for i in range(5)] == [25.0, 50.0, 75.0, 100.0, 50.0]
    assert [ranked[f"T{i}"]["priority_level"] for i in range(5)] == ["Low", "Medium", "High", "Critical", "Medium"]


def test_first_event_wins_where_an_id_is_on_two_rails(make_events):
    events = make_events(
        {"transaction_id": "X", "rail_type": "WIRE", "amount": 10.0, "format_validation_status": "FAILED"},
        {"transaction_id": "X", "rail_type": "ACH", "amount": -30.0},
    )
    row = priority.with_issue_priority(operations.format_rejections(events, NOW), events).first()
    assert (row.first_event.rail_type, row.total_amount, row.event_count) == ("WIRE", 40.0, 2)


@pytest.mark.parametrize("rule", [operations.duplicate_payments, operations.format_rejections])
def test_rules_find_nothing_in_nothing(make_events, rule):
    assert rule(make_events({"status": "SETTLED"}), NOW).count() == 0
