"""Arrivals of PRE and POST files merged into one canonical event per key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping as Table
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railwatch.functions.scalars import is_missing
from railwatch.schema import EVENT_KEY, MAPPED_FIELDS
from railwatch.sources.files import POSITION, read_delimited
from railwatch.sources.mapping import good_rows, load_mappings, map_keys, project


def arrivals(
    mapped: DataFrame, tenant: str, rail: str, stage: str, file_number: int, arrived_at: dt.datetime
) -> DataFrame:
    """Good rows of one file, stamped with their key, stage and arrival order."""
    return mapped.select(
        F.lit(tenant).alias("tenant_bank_id"),
        F.lit(rail).alias("rail_type"),
        "*",
        F.lit(stage == "PRE").alias("is_pre"),
        F.struct(F.lit(file_number).alias("file"), F.col(POSITION).alias("position")).alias("arrival_seq"),
        F.lit(arrived_at).cast("timestamp").alias("arrived_at"),
    ).drop(POSITION)


def ingest_files(
    spark: SparkSession,
    mapping_rows: DataFrame,
    files: Sequence[tuple[str, str, str, str]],
    arrived_at: dt.datetime,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Merge (tenant, rail, stage, path) files in the given order, into ``existing`` events if given."""
    parts, keys = [], {}
    for number, (tenant, rail, stage, path) in enumerate(files):
        mappings = load_mappings(mapping_rows, tenant, rail)
        rows = good_rows(project(read_delimited(spark, path), mappings))
        parts.append(arrivals(rows, tenant, rail, stage, number, arrived_at))
        for field, columns in map_keys(mappings).items():
            keys.setdefault(field, [])
            keys[field] += [c for c in columns if c not in keys[field]]
    return canonical_merge(reduce(DataFrame.unionByName, parts), keys, existing=existing)


def populated(field: str) -> Column:
    kind, value = MAPPED_FIELDS[field], F.col(field)
    if isinstance(kind, T.MapType):
        return value.isNotNull() & (F.size(value) > 0)
    if isinstance(kind, T.StringType):
        return ~is_missing(value)
    return value.isNotNull()


def _latest(value: Column, holds: Column) -> Column:
    """The value of the last arrival for which ``holds`` is true."""
    return F.max_by(value, F.when(holds, F.col("seq")))


def _in_one_shape(arrived: DataFrame, existing: DataFrame | None, fields: Sequence[str]) -> DataFrame:
    """Arrivals, and known events as arrivals that came before all others."""

    def shaped(rows: DataFrame, run: int, pre: Column, post: Column, first: str, last: str, order: str) -> DataFrame:
        return rows.select(
            *EVENT_KEY,
            *fields,
            pre.alias("pre_row"),
            post.alias("post_row"),
            F.col(first).alias("seen_from"),
            F.col(last).alias("seen_to"),
            F.struct(F.lit(run).alias("run"), F.col(order).alias("order")).alias("seq"),
        )

    raw, is_pre = F.col("raw_row"), F.col("is_pre")
    new = shaped(arrived, 1, F.when(is_pre, raw), F.when(~is_pre, raw), "arrived_at", "arrived_at", "arrival_seq")
    if existing is None:
        return new
    known = (F.col("snapshot_pre"), F.col("snapshot_post"))
    return shaped(existing, 0, *known, "first_seen_at", "last_updated_at", "event_ordinal").unionByName(new)


def _other_entries(rows: DataFrame, maps: Table[str, Sequence[str]]) -> DataFrame:
    """Map entries under keys the configuration does not name: a row per event that has some, a map per field.

    They are combined by (event, field, key), so what is gathered per event is
    one entry per key.
    """

    def entries(field: str) -> Column:
        known = list(maps[field])
        unnamed = F.map_filter(field, lambda key, value: value.isNotNull() & (~key.isin(*known) if known else F.lit(True)))
        return F.transform(
            F.coalesce(F.map_entries(unnamed), F.array().cast("array<struct<key:string,value:string>>")),
            lambda e: F.struct(F.lit(field).alias("field"), e["key"].alias("key"), e["value"].alias("value")),
        )

    found = rows.select(*EVENT_KEY, "seq", F.explode(F.concat(*(entries(f) for f in maps))).alias("entry"))
    latest = found.groupBy(*EVENT_KEY, "entry.field", "entry.key").agg(F.max_by("entry.value", "seq").alias("value"))
    pair = F.struct("key", "value")
    return latest.groupBy(*EVENT_KEY).agg(
        *(F.map_from_entries(F.collect_list(F.when(F.col("field") == f, pair))).alias(f"__more_{f}") for f in maps)
    )


def canonical_merge(
    arrived: DataFrame,
    keys: Table[str, Sequence[str]],
    fields: Sequence[str] = tuple(MAPPED_FIELDS),
    existing: DataFrame | None = None,
) -> DataFrame:
    """One row per (tenant, rail, transaction), merged into ``existing`` events if given.

    The last populated value of a field wins and a blank never overwrites. Map
    fields merge key by key. The keys that the mapping names are aggregates
    beside the other fields, so they combine before the shuffle and no list of
    arrivals is ever collected; keys under other names are merged apart and
    joined to the few events that have any. Known events keep their first raw
    rows, their first time and their place.
    """
    scalars = [f for f in fields if not isinstance(MAPPED_FIELDS[f], T.MapType)]
    maps = {f: list(keys.get(f, ())) for f in fields if isinstance(MAPPED_FIELDS[f], T.MapType)}
    rows = _in_one_shape(arrived, existing, fields)

    merged = [_latest(F.col(f), populated(f)).alias(f) for f in scalars]
    for field, columns in maps.items():
        for number, column in enumerate(columns):
            value = F.try_element_at(F.col(field), F.lit(column))
            merged.append(_latest(value, value.isNotNull()).alias(f"__{field}_{number}"))
    first_raw = [
        F.min_by(row, F.when(F.col(row).isNotNull(), F.col("seq"))).alias(name)
        for name, row in (("snapshot_pre", "pre_row"), ("snapshot_post", "post_row"))
    ]
    grouped = rows.groupBy(*EVENT_KEY).agg(
        *merged,
        *first_raw,
        F.min("seen_from").alias("first_seen_at"),
        F.max("seen_to").alias("last_updated_at"),
        F.min("seq").alias("first_seq"),
    )
    if maps:
        grouped = grouped.join(_other_entries(rows, maps), list(EVENT_KEY), "left")

    def rebuilt(field: str) -> Column:
        columns = maps[field]
        more = F.coalesce(f"__more_{field}", F.create_map().cast(MAPPED_FIELDS[field]))
        if columns:
            parts = [p for n, c in enumerate(columns) for p in (F.lit(c), F.col(f"__{field}_{n}"))]
            own = F.map_filter(F.create_map(*parts), lambda _key, value: value.isNotNull())
            more = F.map_concat(own, more)
        return F.when(F.size(more) > 0, more)

    return grouped.select(
        *EVENT_KEY,
        *((rebuilt(f) if f in maps else F.col(f)).alias(f) for f in fields),
        "snapshot_pre",
        "snapshot_post",
        "first_seen_at",
        "last_updated_at",
        F.col("first_seq.order").alias("event_ordinal"),
    )
