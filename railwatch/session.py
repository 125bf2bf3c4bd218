"""Session settings the jobs rely on, and lineage cutting."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Inputs up to this many bytes are dealt out over the cores before they are used.
SMALL_INPUT = 256 << 20

# Settings that change results, so every job needs them.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to an existing session."""
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_fallback_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for cut lineage; one of our own only in a local session that names none."""
    global _fallback_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _fallback_folder is None:
        _fallback_folder = tempfile.mkdtemp(prefix="railwatch-")
    return _fallback_folder


class InputState(NamedTuple):
    """Size and last change of the files under a path."""

    size: int
    changed: dt.datetime | None


def input_state(spark: SparkSession, path: str) -> InputState:
    """From the listing alone; no file is opened."""
    files = spark.read.format("binaryFile").load(path)
    return InputState(*files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.max("modificationTime")).first())


def spread(df: DataFrame, size: int) -> DataFrame:
    """Deal out an input of few bytes, which would be read in fewer splits than there are cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Later steps scan only the columns they need, plan against a plain table,
    and do not redo the stage when an executor is lost.
    """
    path = f"{shared_folder(df.sparkSession)}/railwatch-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
