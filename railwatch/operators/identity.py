"""Source ids resolved to canonical merchants and individuals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railwatch.functions.scalars import account_type, non_empty
from railwatch.functions.skew import join_dealt

_PREFIX = {"merchant_id": "MER", "individual_id": "IND"}
_MERCHANT_COLUMNS = ("legal_name", "merchant_account", "processor_name", "onboarded_by")
_INDIVIDUAL_COLUMNS = ("full_name", "account_ref", "account_type", "onboarded_by")


class Resolution(NamedTuple):
    events: DataFrame
    merchants: DataFrame
    individuals: DataFrame
    warnings: DataFrame
    counts: DataFrame


def canonical_id(prefix: str, source: str) -> Column:
    """An id that only depends on tenant and source id, so re-runs agree."""
    digest = F.sha2(F.concat_ws("|", "tenant_bank_id", source), 256)
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(digest, 1, 16)))


def _first(value: Column) -> Column:
    """The first non-null value in event order."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("event_ordinal")))


def _registered(found: DataFrame, existing: DataFrame | None, identity: str, source: str, columns) -> DataFrame:
    """The registry with new ids added and gaps of known ids filled, never overwritten."""
    key = ["tenant_bank_id", source]
    fresh = found.withColumn(identity, canonical_id(_PREFIX[identity], source))
    if existing is None:
        return fresh.select(identity, *key, *columns, F.lit(True).alias("is_new"))
    known = existing.select(*key, F.col(identity).alias("__id"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = fresh.join(known, key, "full_outer")
    return joined.select(
        F.coalesce("__id", identity).alias(identity),
        *key,
        *(F.coalesce(f"__{c}", c).alias(c) for c in columns),
        F.col("__id").isNull().alias("is_new"),
    )


def _unresolved_merchant() -> Column:
    return F.col("source_merchant_id").isNotNull() & F.col("merchant_id").isNull()


def _unresolved_individual() -> Column:
    """Rows the merchant pass leaves alone and that only name an individual."""
    return (
        F.col("source_individual_id").isNotNull()
        & F.col("individual_id").isNull()
        & F.col("merchant_id").isNull()
        & F.col("source_merchant_id").isNull()
    )


def merchant_registry(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    account = non_empty(F.col("payer_account_ref"))
    found = (
        events.filter(_unresolved_merchant())
        .groupBy("tenant_bank_id", "source_merchant_id")
        .agg(
            _first(non_empty(F.col("payer_name"))).alias("legal_name"),
            _first(account).alias("account"),
            _first(non_empty(F.col("processor_name"))).alias("processor_name"),
            _first(non_empty(F.col("onboarded_by"))).alias("onboarded_by"),
        )
        .withColumn(
            "merchant_account", F.when(F.col("account").isNotNull(), F.create_map(F.lit("account_ref"), F.col("account")))
        )
        .drop("account")
    )
    return _registered(found, existing, "merchant_id", "source_merchant_id", _MERCHANT_COLUMNS)


def individual_registry(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    found = (
        events.filter(_unresolved_individual())
        .groupBy("tenant_bank_id", "source_individual_id")
        .agg(
            _first(non_empty(F.col("payer_name"))).alias("full_name"),
            _first(non_empty(F.col("payer_account_ref"))).alias("account_ref"),
            _first(non_empty(account_type(F.col("risk_flags")))).alias("account_type"),
            _first(non_empty(F.col("onboarded_by"))).alias("onboarded_by"),
        )
    )
    return _registered(found, existing, "individual_id", "source_individual_id", _INDIVIDUAL_COLUMNS)


def exclusivity_warnings(events: DataFrame) -> DataFrame:
    """Rows that named both a merchant and an individual; the merchant wins."""
    both = events.filter(_unresolved_merchant() & non_empty(F.col("source_individual_id")).isNotNull())
    return both.select("tenant_bank_id", "rail_type", "transaction_id", F.lit("mutual_exclusivity_warning").alias("type"))


def _assign(registry: DataFrame | None, identity: str, source: str, applies: Column) -> Column:
    known = F.col(f"__{identity}") if registry is not None else F.lit(None).cast("string")
    fresh = canonical_id(_PREFIX[identity], source)
    return F.when(applies, F.coalesce(known, fresh)).otherwise(F.col(identity))


def resolve_events(
    events: DataFrame, merchants: DataFrame | None = None, individuals: DataFrame | None = None
) -> DataFrame:
    """Events with their canonical ids; rows that carry an id already keep it.

    New ids are computed from the source id, so only ids that an earlier
    registry already issued need a join.
    """
    joined = events
    for registry, identity, source in (
        (merchants, "merchant_id", "source_merchant_id"),
        (individuals, "individual_id", "source_individual_id"),
    ):
        if registry is not None:
            known = registry.select("tenant_bank_id", source, F.col(identity).alias(f"__{identity}"))
            joined = join_dealt(joined, known, ["tenant_bank_id", source], "left")
    both = _unresolved_merchant() & non_empty(F.col("source_individual_id")).isNotNull()
    merchant = _assign(merchants, "merchant_id", "source_merchant_id", _unresolved_merchant())
    individual = F.when(both, F.lit(None)).otherwise(
        _assign(individuals, "individual_id", "source_individual_id", _unresolved_individual())
    )
    resolved = joined.withColumns({"merchant_id": merchant, "individual_id": individual})
    return resolved.drop("__merchant_id", "__individual_id").select(*events.columns)


def resolution_counts(
    events: DataFrame, merchants: DataFrame, individuals: DataFrame
) -> DataFrame:
    """Resolved, created, skipped and warned rows per tenant."""
    both = _unresolved_merchant() & non_empty(F.col("source_individual_id")).isNotNull()
    sourceless = F.col("source_merchant_id").isNull() & F.col("source_individual_id").isNull()
    counts = events.groupBy("tenant_bank_id").agg(
        F.count_if(_unresolved_merchant()).alias("resolved_merchants"),
        F.count_if(_unresolved_individual()).alias("resolved_individuals"),
        F.count_if(sourceless).alias("skipped_without_source"),
        F.count_if(both).alias("exclusivity_warnings"),
    )
    for registry, name in ((merchants, "created_new_merchants"), (individuals, "created_new_individuals")):
        created = registry.groupBy("tenant_bank_id").agg(F.count_if("is_new").alias(name))
        counts = counts.join(created, "tenant_bank_id", "left")
    return counts.fillna(0)


def resolve_parties(
    events: DataFrame, merchants: DataFrame | None = None, individuals: DataFrame | None = None
) -> Resolution:
    merchant_rows = merchant_registry(events, merchants)
    individual_rows = individual_registry(events, individuals)
    return Resolution(
        resolve_events(events, merchants, individuals),
        merchant_rows,
        individual_rows,
        exclusivity_warnings(events),
        resolution_counts(events, merchant_rows, individual_rows),
    )


def directory(registry: DataFrame, events: DataFrame, identity: str, columns, search: str | None = None) -> DataFrame:
    """Registry rows whose id or names contain ``search``, with activity counts."""
    wanted = registry
    if search:
        hit = F.lit(False)
        for column in (identity, *columns):
            hit = hit | F.coalesce(F.contains(F.lower(F.col(column)), F.lit(search.lower())), F.lit(False))
        wanted = registry.filter(hit)
    activity = (
        events.filter(F.col(identity).isNotNull())
        .groupBy("tenant_bank_id", identity)
        .agg(F.count(F.lit(1)).alias("transaction_count"), F.array_sort(F.collect_set("rail_type")).alias("rails_active"))
    )
    joined = wanted.join(activity, ["tenant_bank_id", identity], "left")
    return joined.fillna(0, ["transaction_count"]).withColumn(
        "rails_active", F.coalesce("rails_active", F.array().cast("array<string>"))
    )
