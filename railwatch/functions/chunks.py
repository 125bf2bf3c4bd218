"""Rows of unevenly sized groups processed in bounded chunks beside a small per-group model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.joins import join_small

CHUNK_ROWS = 100_000


def map_chunks(
    rows: DataFrame,
    models: DataFrame,
    group: Sequence[str],
    key: str,
    function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Apply ``function(chunk, model_rows)`` to about ``chunk_rows`` rows at a time.

    A group is cut by a hash of ``key`` into as many chunks as its size asks
    for, and its model rows are repeated once per chunk, so a group with a
    third of all rows is spread over as many tasks as it fills.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("__chunks"))
    chunk = F.pmod(F.xxhash64(key), F.col("__chunks")).cast("int").alias("__chunk")
    cut = join_small(rows, sizes, group).select(*rows.columns, chunk)
    every = F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk")
    repeated = models.join(sizes, list(group)).select(*models.columns, every)
    keys = [*group, "__chunk"]
    return cut.groupBy(*keys).cogroup(repeated.groupBy(*keys)).applyInPandas(function, schema)
