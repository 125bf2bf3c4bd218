"""Joins of a large table in which a few keys may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that a task may hold; keys with more are dealt out.
DEAL_ROWS = 500_000
# Each map task counts with so many counters, so a key with more than this part of all rows is never missed ...
TRACKED = 1024
# ... and so many of the most frequent keys are looked at.
LOOKED_AT = 256


def frequent_keys(rows: DataFrame, keys: Sequence[str], deal_rows: int = DEAL_ROWS) -> dict[int, int]:
    """Hash of each key (null ones too) that more than ``deal_rows`` rows have, and the tasks to deal them to.

    Map tasks keep a bounded sketch of their most frequent keys and the sketches
    are merged, so no key is shuffled to be counted. Below ``DEAL_ROWS`` times
    ``TRACKED`` rows in all no such key can be missed; beyond that, one that is
    missed has less than a thousandth of all rows.
    """
    sketch = F.expr(f"approx_top_k(__key, {LOOKED_AT}, {TRACKED})").alias("found")
    found = rows.select(F.xxhash64(*keys).alias("__key")).agg(sketch).first().found
    return {r["item"]: -(-r["count"] // deal_rows) for r in found or [] if r["count"] > deal_rows}


def _salts(key: Column, frequent: dict[int, int]) -> Column:
    pairs = [F.lit(v) for pair in frequent.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(1))


def join_dealt(
    rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str = "inner", deal_rows: int | None = None
) -> DataFrame:
    """Join ``rows``, whose frequent keys are dealt over many tasks, to ``others``.

    Only the rows of frequent keys get a salt, by a hash of their columns (maps
    left out), so a task that runs again deals alike; and only the rows of
    ``others`` with these keys are repeated, once per salt. All other rows meet
    as in a plain join. ``how`` is inner, left, left_semi or left_anti. Without
    frequent keys it is the plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows that match nothing in repeated others would be told twice by a {how} join")
    frequent = frequent_keys(rows, keys, deal_rows or DEAL_ROWS)
    if not frequent:
        return rows.join(others, list(keys), how)
    salts = _salts(F.xxhash64(*keys), frequent)
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit("deal"), *hashed), salts.cast("long")).cast("int"))
    repeated = others.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")
