"""Filtered, ordered pages; peers are always ranked before anything is filtered."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.dates import day_in_range


class Page(NamedTuple):
    rows: DataFrame
    total: int


def page(
    rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0, ranges: Column | None = None
) -> Page:
    """One page in a given order, with the number of rows in all pages.

    ``ranges`` is a function of the first order key, of few values, that ascends
    with the order (negate it for a descending key). Rows are counted per range;
    only the ranges that the page lies in are read again and sorted, however
    deep the page is. Without it every row takes part in the sorting.
    """
    if ranges is None:
        return Page(rows.orderBy(*order).offset(offset).limit(limit), rows.count())
    counted = rows.groupBy(ranges.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(F.asc_nulls_first("range"))) - F.col("n")  # one row per range
    found = counted.withColumn("before", before).select(
        "*", F.sum("n").over(Window.partitionBy()).alias("total")
    )
    held = found.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    edges = held.agg(F.min("range"), F.max("range"), F.min("before"), F.count(F.lit(1)), F.count("range")).first()
    first, last, skipped, some, named = edges
    total = found.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    if not some:
        return Page(rows.limit(0), total)
    within = ranges.between(first, last) if named else F.lit(False)
    inside = rows.filter(within if named == some else within | ranges.isNull())
    return Page(inside.orderBy(*order).offset(offset - skipped).limit(limit), total)


def _matching(rows: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def issues(
    ranked: DataFrame, tenant: str, issue_type: str | None = None, priority_level: str | None = None
) -> DataFrame:
    """Issues of a tenant, newest first."""
    found = _matching(
        ranked,
        tenant_bank_id=tenant,
        issue_type=issue_type and issue_type.upper(),
        priority_level=priority_level and priority_level.capitalize(),
    )
    return found.orderBy(F.desc("detected_at"), "issue_id")


def breaks(
    ranked: DataFrame, tenant: str, detection_type: str | None = None, priority_level: str | None = None
) -> DataFrame:
    """Breaks of a tenant, newest first."""
    found = _matching(
        ranked,
        tenant_bank_id=tenant,
        detection_type=detection_type and detection_type.upper(),
        priority_level=priority_level and priority_level.capitalize(),
    )
    return found.orderBy(F.desc("detected_at"), "break_id")


def snapshots(
    tagged: DataFrame,
    tenant: str | None = None,
    party_id: str | None = None,
    segment: str | None = None,
    split: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Snapshots with their tags; the tags come from the whole segment."""
    found = _matching(tagged, tenant_bank_id=tenant, party_id=party_id, segment=segment, split=split)
    return found.filter(day_in_range(F.col("window_end"), start, end))


def cases(
    anchored: DataFrame,
    tenant: str,
    priority_level: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Cases in a window of their real event time, newest first."""
    found = _matching(anchored, tenant_bank_id=tenant, priority_level=priority_level and priority_level.capitalize())
    return found.filter(day_in_range(F.col("anchor_ts"), start, end)).orderBy(F.desc("opened_at"), "case_code")


def beneficiaries(
    rows: DataFrame, tenant: str, beneficiary_key: str | None = None, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Beneficiary weeks of a tenant by key and week; one of them has the snapshot's id."""
    found = _matching(rows, tenant_bank_id=tenant, beneficiary_key=beneficiary_key)
    return found.filter(day_in_range(F.col("window_end"), start, end)).orderBy("beneficiary_key", "window_start")


def party_features(features: DataFrame, tenant: str | None = None, party_type: str | None = None) -> DataFrame:
    return _matching(features, tenant_bank_id=tenant, party_type=party_type)
