"""Inclusive calendar-day windows over texts and instants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_in_range(text: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """Compare an ISO text with day bounds as text, so the scan can filter on it."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (text >= start.isoformat())
    if end is not None:
        condition = condition & (text < (end + dt.timedelta(days=1)).isoformat())
    return condition


def day_in_range(day: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """True where a date or instant lies in the window; a null is outside any window."""
    if start is None and end is None:
        return F.lit(True)
    condition = day.isNotNull()
    if start is not None:
        condition = condition & (F.to_date(day) >= F.lit(start))
    if end is not None:
        condition = condition & (F.to_date(day) <= F.lit(end))
    return condition
