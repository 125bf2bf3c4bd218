"""The tables of a run, each built from the ones before it and built once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railwatch.operators import (
    cases,
    density,
    drift,
    exposure,
    forest,
    identity,
    lookup,
    operations,
    priority,
    reconciliation,
    review,
    scoring,
    snapshots,
    trends,
    vectors,
)
from railwatch.session import stored
from railwatch.plans.testdata import AS_OF, DETECTED_AT, canonical_events, derived_reviews


class Workbench:
    """Lazily composed jobs over one data folder.

    The anomaly band of these tables comes from the drift score alone;
    ``fully_scored`` is the same run with bands from forest, clusters and drift.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.runs: dict[str, ScoredRun] = {}

    @cached_property
    def events(self) -> DataFrame:
        return stored(canonical_events(self.spark, self.sf_dir), "events")

    @cached_property
    def unresolved(self) -> DataFrame:
        """The same events before their parties are resolved."""
        no_id = F.lit(None).cast("string")
        return self.events.withColumns({"merchant_id": no_id, "individual_id": no_id})

    @cached_property
    def tenants(self) -> DataFrame:
        return self.events.select("tenant_bank_id").distinct()

    @cached_property
    def merchants(self) -> DataFrame:
        return identity.merchant_registry(self.unresolved)

    @cached_property
    def individuals(self) -> DataFrame:
        return identity.individual_registry(self.unresolved)

    @cached_property
    def snapshots(self) -> DataFrame:
        return stored(drift.with_merchant_drift(snapshots.entity_snapshots(self.events)), "snapshots")

    @cached_property
    def banded(self) -> DataFrame:
        scored = scoring.with_band(self.snapshots, F.coalesce("timeseries_drift_score", F.lit(0.0)))
        return scored.withColumns(
            {
                "isolation_forest_score": F.lit(None).cast("double"),
                "cluster_changed": F.lit(None).cast("boolean"),
            }
        )

    @cached_property
    def forest_scores(self) -> DataFrame:
        return stored(forest.segment_scores(self.snapshots, on_upgraded_tier="baseline"), "forest_scores")

    @cached_property
    def clustered(self) -> DataFrame:
        labels = density.density_clusters(vectors.cluster_vectors(self.snapshots))
        joined = self.snapshots.join(labels.select("snapshot_id", "cluster_id"), "snapshot_id")
        return stored(density.with_cluster_change(joined), "clustered")

    @cached_property
    def scored(self) -> DataFrame:
        """Snapshots with all three signals and the final score."""
        forest_score = self.forest_scores.select("snapshot_id", "isolation_forest_score")
        return scoring.with_final_score(self.clustered.join(forest_score, "snapshot_id", "left"))

    @cached_property
    def beneficiaries(self) -> DataFrame:
        return stored(drift.with_funnel_drift(snapshots.beneficiary_snapshots(self.events)), "beneficiaries")

    @cached_property
    def issues(self) -> DataFrame:
        return stored(operations.operational_issues(self.events, self.snapshots, AS_OF, DETECTED_AT), "issues")

    @cached_property
    def found_issues(self) -> DataFrame:
        return stored(lookup.with_events(self.issues, self.events), "found_issues")

    @cached_property
    def ranked_issues(self) -> DataFrame:
        return stored(priority.rank_issues(self.found_issues), "ranked_issues")

    @cached_property
    def breaks(self) -> DataFrame:
        return reconciliation.reconciliation_breaks(self.events, DETECTED_AT)

    @cached_property
    def found_breaks(self) -> DataFrame:
        return stored(self.breaks, "found_breaks")

    @cached_property
    def ranked_breaks(self) -> DataFrame:
        return stored(priority.with_break_priority(self.found_breaks), "ranked_breaks")

    @cached_property
    def claims(self) -> DataFrame:
        return exposure.claims(self.found_issues, self.found_breaks, self.banded)

    @cached_property
    def claim_ids(self) -> DataFrame:
        return review.claim_ids(self.found_issues, self.breaks, self.banded, self.beneficiaries)

    @cached_property
    def reviews(self) -> DataFrame:
        return derived_reviews(self.claim_ids)

    @cached_property
    def claim_reviews(self) -> DataFrame:
        """Reviews of dollar claims only, which exposure views join to."""
        return derived_reviews(self.claims)

    @cached_property
    def alerts(self) -> DataFrame:
        return stored(cases.case_alerts(cases.signals(self.ranked_issues, self.ranked_breaks, self.banded)), "alerts")

    @cached_property
    def cases(self) -> DataFrame:
        return stored(cases.investigation_cases(self.alerts), "cases")

    @cached_property
    def anchored_cases(self) -> DataFrame:
        return cases.case_anchors(self.cases, self.alerts)

    @cached_property
    def weekly_counts(self) -> DataFrame:
        return stored(trends.weekly_counts(self.found_issues, self.found_breaks, self.banded), "weekly_counts")

    @cached_property
    def trends(self) -> DataFrame:
        return trends.category_trends(self.weekly_counts)

    @cached_property
    def fully_scored(self) -> ScoredRun:
        """The run whose health, exposure, reviews, cases, trends and facts follow the weighted score."""
        return ScoredRun(self, lambda: self.scored)


class ScoredRun(Workbench):
    """The tables of a run over other bands.

    ``banded`` gives the snapshots with their score and band. Tables that no
    band enters are those of ``base`` and are not built again.
    """

    def __init__(self, base: Workbench, banded: Callable[[], DataFrame]):
        super().__init__(base.spark, base.sf_dir)
        self.base, self._banded = base, banded

    @cached_property
    def banded(self) -> DataFrame:
        return stored(self._banded(), "banded")


def _of_base(name: str) -> property:
    return property(lambda run: getattr(run.base, name))


for _name in (
    "events unresolved tenants merchants individuals snapshots forest_scores clustered scored beneficiaries"
    " issues found_issues ranked_issues breaks found_breaks ranked_breaks"
).split():
    setattr(ScoredRun, _name, _of_base(_name))
