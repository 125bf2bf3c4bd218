"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sorts before every real id; stands for a null one.
NO_ID = -(2**63)

# Arrow batches end at this many bytes, so long texts do not pile up in a Python worker.
BATCH_BYTES = 4 << 20

# Words are runs of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keep the Arrow batches of this session's Python stages to a bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _give_back() -> None:
    """Return freed memory to the system where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, whose worker keeps no freed memory for itself between tasks; for stages that take texts apart."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def id_order(name: str = "doc_id") -> Column:
    """The id as a sort key that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_mark(name: str = "text") -> Column:
    """A hash of the text, which tells rows apart that share an id; 0 for a null text."""
    return F.when(F.col(name).isNotNull(), F.xxhash64(name)).otherwise(F.lit(0)).cast("long")


def schema_of(df: DataFrame, *names: str) -> str:
    """A schema string of some columns of a table."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def texts(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def held_out(name: str = "doc_id", folds: int = 5) -> Column:
    """True for the fold that no model of this package learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % folds == 0, F.lit(False))
