"""Joins of a large table to one row per tenant or segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.session import stored

BROADCAST_ROWS = 100_000


def join_small(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join to a table that is expected to be small, by broadcast once its size is known to be.

    Shuffling ``rows`` by a tenant or segment would put a third of them into
    one task. ``small`` is stored and counted first; above ``limit`` the keys
    are many and an ordinary join spreads them, with skewed ones split at run
    time.
    """
    kept = stored(small, "small")
    return rows.join(F.broadcast(kept) if kept.count() <= limit else kept, list(keys), how)
