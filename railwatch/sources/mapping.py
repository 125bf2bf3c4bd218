"""Mapping-driven projection of raw rows to canonical fields."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railwatch.functions.scalars import is_missing, masked_last4, normalized_status, to_boolean, to_number
from railwatch.schema import MAPPED_FIELDS
from railwatch.sources.files import POSITION, source_columns, unmapped_columns
from railwatch.sources.layouts import DIRECT, JSON_MERGE, LAST4_MASK, NORMALIZE_ENUM, RENAME, Mapping

MAPPING_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in Mapping._fields])


def mapping_table(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    return spark.createDataFrame(list(rows), MAPPING_SCHEMA)


def load_mappings(table: DataFrame, tenant: str, rail: str) -> list[Mapping]:
    """The configured rows of one tenant and rail; a table of a few hundred rows in all."""
    wanted = table.filter((F.col("tenant_bank_id") == tenant) & (F.col("rail_type") == rail))
    return [Mapping(**row.asDict()) for row in wanted.collect()]


def reseed(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace every row of the tenants that ``rows`` names."""
    tenants = rows.select("tenant_bank_id").distinct()
    return table.join(tenants, "tenant_bank_id", "left_anti").unionByName(rows)


def add_missing(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the rows whose assignment is not configured yet."""
    keys = ["tenant_bank_id", "rail_type", "source_column_name", "canonical_field_name", "condition_value"]
    known = table.alias("known")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"new.{key}").eqNullSafe(F.col(f"known.{key}"))
    return table.unionByName(rows.alias("new").join(known, same, "left_anti"))


def _transformed(mapping: Mapping) -> tuple[Column, Column]:
    """Value and error text of one mapping before it is coerced."""
    source = F.col(f"`{mapping.source_column_name}`")
    missing = is_missing(source)
    no_error = F.lit(None).cast("string")
    kind = mapping.transform_type
    if kind in (DIRECT, RENAME, JSON_MERGE):
        return F.when(~missing, source), no_error
    if kind == NORMALIZE_ENUM:
        return F.when(~missing, normalized_status(source)), no_error
    if kind == LAST4_MASK:
        return F.when(~missing, masked_last4(source)), no_error
    return F.lit(None).cast("string"), F.when(~missing, F.lit(f"no such transform: {kind}"))


def _coerced(value: Column, target: T.DataType) -> tuple[Column, Column]:
    """Value in the target type, and an error text where it cannot be read."""
    if isinstance(target, T.BooleanType):
        typed, text = to_boolean(value), "not a boolean: %s"
    elif isinstance(target, T.DoubleType):
        typed, text = to_number(value), "not a number: %s"
    else:
        return value, F.lit(None).cast("string")
    return typed, F.when(value.isNotNull() & typed.isNull(), F.format_string(text, value))


def _applies(mapping: Mapping, columns: Sequence[str]) -> Column | None:
    """Where the mapping's condition holds; None where it can never hold."""
    if not mapping.condition_column:
        return F.lit(True)
    if mapping.condition_column not in columns:
        return F.lit(True) if mapping.condition_value is None else None
    return F.col(f"`{mapping.condition_column}`").eqNullSafe(F.lit(mapping.condition_value))


def map_keys(mappings: Sequence[Mapping]) -> dict[str, list[str]]:
    """Source columns that feed each map field."""
    keys: dict[str, list[str]] = defaultdict(list)
    for mapping in mappings:
        if mapping.transform_type == JSON_MERGE and mapping.source_column_name not in keys[mapping.canonical_field_name]:
            keys[mapping.canonical_field_name].append(mapping.source_column_name)
    return dict(keys)


def project(raw: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Canonical fields of each raw row, its error if it failed, and the raw cells.

    A later mapping of a field wins where its condition holds, even with a null.
    The first failing mapping fails the whole row.
    """
    columns = source_columns(raw)
    fields: dict[str, Column] = {}
    entries: dict[str, list[Column]] = defaultdict(list)
    errors: list[Column] = []
    for mapping in mappings:
        applies = _applies(mapping, columns)
        if applies is None or mapping.source_column_name not in columns:
            continue
        name = mapping.canonical_field_name
        target = MAPPED_FIELDS.get(name, T.StringType())
        if isinstance(target, T.MapType) != (mapping.transform_type == JSON_MERGE):
            raise ValueError(f"{name} cannot be filled by {mapping.transform_type}")
        value, transform_error = _transformed(mapping)
        typed, coerce_error = _coerced(value, target)
        errors.append(F.when(applies, F.coalesce(transform_error, coerce_error)))
        if mapping.transform_type == JSON_MERGE:
            entries[name] += [F.lit(mapping.source_column_name), F.when(applies, typed)]
        else:
            before = fields.get(name, F.lit(None).cast(target))
            fields[name] = F.when(applies, typed).otherwise(before)
    for name, parts in entries.items():
        fields[name] = F.map_filter(F.create_map(*parts), lambda _key, value: value.isNotNull())

    transaction = fields.pop("transaction_id", F.lit(None).cast("string"))
    no_id = F.when(
        transaction.isNull() | (transaction == ""), F.lit("the mapping gives this row no transaction_id")
    )
    cells = F.create_map(*(part for c in columns for part in (F.lit(c), F.col(f"`{c}`")))) if columns else F.lit(None)
    return raw.select(
        transaction.alias("transaction_id"),
        *(
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in MAPPED_FIELDS.items()
        ),
        F.coalesce(*errors, no_id).alias("error"),
        cells.alias("raw_row"),
        F.col(POSITION),
    )


def good_rows(projected: DataFrame) -> DataFrame:
    return projected.filter(F.col("error").isNull()).drop("error")


def failed_rows(projected: DataFrame) -> DataFrame:
    """Quarantined rows with their position and message."""
    return projected.filter(F.col("error").isNotNull()).select(POSITION, "error", "raw_row")


def ingestion_log(
    projected: DataFrame, raw: DataFrame, mappings: Sequence[Mapping], tenant: str, rail: str, stage: str, file_name: str
) -> DataFrame:
    """One row per file: rows read, mapped and failed, and columns no mapping names.

    The failed rows themselves are :func:`failed_rows`, kept as a table so that
    a file full of errors does not end up in one cell.
    """
    unmapped = unmapped_columns(source_columns(raw), [m.source_column_name for m in mappings])
    listed = F.array(*(F.lit(c) for c in unmapped)) if unmapped else F.array().cast("array<string>")
    return projected.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("error").isNull()).alias("rows_mapped"),
        F.count("error").alias("rows_failed"),
    ).select(
        F.lit(file_name).alias("file_name"),
        F.lit(tenant).alias("tenant_bank_id"),
        F.lit(rail).alias("rail_type"),
        F.lit(stage).alias("settlement_stage"),
        "row_count",
        "rows_mapped",
        "rows_failed",
        listed.alias("unmapped_columns"),
        F.current_timestamp().alias("ingested_at"),
    )
