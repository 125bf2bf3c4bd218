"""Sinks: whole-scope replacement, appending, and keyed state on a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tenant_path(path: str, tenant: str) -> str:
    return f"{path}/tenant_bank_id={tenant}"


def replace_scope(rows: DataFrame, path: str, tenant: str | None = None) -> None:
    """Replace a tenant's rows, or all rows, even where the new rows are none.

    A tenant owns one folder, which is overwritten as a whole, so a run that
    finds nothing also clears what an earlier run found.
    """
    if tenant is None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tenant_bank_id").parquet(path)
        return
    own = rows.filter(F.col("tenant_bank_id") == tenant).drop("tenant_bank_id")
    own.write.mode("overwrite").parquet(tenant_path(path, tenant))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_by_key(log: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Current state of a keyed table kept as an append-only log."""
    columns = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("row"))
    return newest.select(*key, "row.*")


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
