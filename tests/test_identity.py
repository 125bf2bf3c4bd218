from conftest import by
from railwatch.operators import identity, parties


def rows(make_events):
    return make_events(
        {"source_merchant_id": "S1", "payer_name": None, "payer_account_ref": "****1"},
        {"source_merchant_id": "S1", "payer_name": "Shop", "processor_name": "P"},
        {"source_merchant_id": "S1", "payer_name": "Other", "source_individual_id": "I9"},
        {"source_individual_id": "I1", "payer_name": "Ann", "risk_flags": {"entity_account_type": "SAVINGS"}},
        {"source_merchant_id": "S1", "tenant_bank_id": "OTHER", "payer_name": "Elsewhere"},
        {"source_merchant_id": "S2", "merchant_id": "MER-KNOWN"},
        {},
    )


def test_resolution(make_events):
    events = rows(make_events)
    result = identity.resolve_parties(events)
    resolved = by(result.events, "transaction_id")
    assert resolved["T0"]["merchant_id"] == resolved["T1"]["merchant_id"] == resolved["T2"]["merchant_id"]
    assert resolved["T4"]["merchant_id"] != resolved["T0"]["merchant_id"]
    assert resolved["T2"]["individual_id"] is None
    assert resolved["T3"]["individual_id"].startswith("IND-") and resolved["T3"]["merchant_id"] is None
    assert resolved["T5"]["merchant_id"] == "MER-KNOWN"
    assert [r.transaction_id for r in result.warnings.collect()] == ["T2"]

    merchants = by(result.merchants, "tenant_bank_id")
    assert len(merchants) == 2
    assert merchants["BANK"]["legal_name"] == "Shop" and merchants["BANK"]["processor_name"] == "P"
    assert merchants["BANK"]["merchant_account"] == {"account_ref": "****1"}
    person = result.individuals.first()
    assert (person.full_name, person.account_type) == ("Ann", "SAVINGS")

    counts = by(result.counts, "tenant_bank_id")["BANK"]
    assert counts == {
        "tenant_bank_id": "BANK",
        "resolved_merchants": 3,
        "resolved_individuals": 1,
        "skipped_without_source": 1,
        "exclusivity_warnings": 1,
        "created_new_merchants": 1,
        "created_new_individuals": 1,
    }


def test_second_run_changes_nothing(make_events):
    first = identity.resolve_parties(rows(make_events))
    second = identity.resolve_parties(first.events, first.merchants, first.individuals)
    assert by(first.events, "transaction_id") == by(second.events, "transaction_id")
    assert second.counts.selectExpr("sum(created_new_merchants + resolved_merchants) AS n").first().n == 0


def test_existing_ids_are_kept_and_gaps_filled(make_events, spark):
    known = spark.createDataFrame(
        [("MER-1", "BANK", "S1", None, None, "Kept", None), ("MER-9", "BANK", "S9", "Quiet", None, None, None)],
        "merchant_id string, tenant_bank_id string, source_merchant_id string, legal_name string, "
        "merchant_account map<string,string>, processor_name string, onboarded_by string",
    )
    events = rows(make_events)
    registry = by(identity.merchant_registry(events, known), "tenant_bank_id", "source_merchant_id")
    assert registry["BANK", "S1"]["merchant_id"] == "MER-1"
    assert (registry["BANK", "S1"]["legal_name"], registry["BANK", "S1"]["processor_name"]) == ("Shop", "Kept")
    assert registry["BANK", "S9"]["legal_name"] == "Quiet"
    assert by(identity.resolve_events(events, known), "transaction_id")["T0"]["merchant_id"] == "MER-1"


def test_directory(make_events):
    events = make_events({"merchant_id": "MER-1", "rail_type": "WIRE"}, {"merchant_id": "MER-1"}, {"merchant_id": "MER-2"})
    spark = events.sparkSession
    registry = spark.createDataFrame(
        [("MER-1", "BANK", "The 100% Shop"), ("MER-3", "BANK", None)], "merchant_id string, tenant_bank_id string, legal_name string"
    )
    found = by(identity.directory(registry, events, "merchant_id", ["legal_name"], "100% s"), "merchant_id")
    assert found["MER-1"]["transaction_count"] == 2 and found["MER-1"]["rails_active"] == ["ACH", "WIRE"]
    assert set(found) == {"MER-1"}
    assert by(identity.directory(registry, events, "merchant_id", ["legal_name"]), "merchant_id")["MER-3"]["transaction_count"] == 0


def test_party_features(make_events):
    events = make_events(
        {"merchant_id": "M", "amount": 10.0, "payee_name": "a", "is_retry": True, "format_validation_status": "FAILED"},
        {"merchant_id": "M", "amount": 30.0, "payee_name": "a", "is_retry": None, "rail_type": "WIRE"},
        {"individual_id": "I"},
        {"payer_name": "nobody"},
    )
    features = by(parties.party_features(events), "party_id")
    m = features["M"]
    assert (m["total_amount"], m["avg_amount"], m["distinct_counterparties"]) == (40.0, 20.0, 1)
    assert (m["is_retry_rate"], m["format_reject_rate"], m["structuring_rate"]) == (1.0, 1.0, None)
    assert m["rails_active"] == ["ACH", "WIRE"]
    assert features["I"]["total_amount"] is None and features["I"]["distinct_counterparties"] is None
    assert set(features) == {"M", "I"}
