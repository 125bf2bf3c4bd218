"""Exact ranks and order statistics of groups too large for one task.

A plain window over a group sorts the whole group in one task. Here each group
is first cut into ordered buckets by fixed functions of the value itself. Rows
are counted per bucket with map-side combining, the bucket totals of a group
are accumulated (a few thousand rows), and only the rows inside one bucket are
sorted together. Bucket edges never depend on sampling, so a recomputed task
sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.skew import join_dealt

# Buckets per doubling of the magnitude.
_STEPS_PER_OCTAVE = 64
_TIE_BUCKETS = 1024


def magnitude_bucket(value: Column) -> Column:
    """A non-decreasing integer function of a double, about 1 % wide per step."""
    steps = F.floor(F.log2(F.abs(value) + 1.0) * _STEPS_PER_OCTAVE)
    return F.when(value < 0, -steps).otherwise(steps)


def unit_bucket(value: Column) -> Column:
    """Buckets for values that lie in [0, 1]."""
    return F.floor(value * 4096)


def day_bucket(instant: Column) -> Column:
    return F.unix_date(F.to_date(instant))


def instant_levels(instant: Column) -> list[Column]:
    """Days, then seconds of a day; a second has at most a million distinct instants."""
    return [day_bucket(instant), F.pmod(F.unix_seconds(instant), F.lit(86_400))]


def tie_bucket(*keys: str) -> Column:
    """Order rows of one value by a hash, so that ties can be split."""
    return F.pmod(F.xxhash64(*keys), F.lit(_TIE_BUCKETS))




def _with_prefixes(
    counted: DataFrame, parents: Sequence[str], level: str, totals: Mapping[str, Column], prefix: str
) -> DataFrame:
    """Add, per total, the sum over the smaller buckets of the same parent."""
    frame = Window.partitionBy(*parents).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumns(
        {f"{prefix}{n}": F.coalesce(F.sum(f"__sum_{n}").over(frame), F.lit(0)) for n in totals}
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    levels: Mapping[str, Column],
    order: Sequence[Column | str],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums in the order (levels..., order) of each group.

    ``levels`` are bucket expressions, coarse to fine, that agree with the
    order. None of the window partitions holds more than the buckets of one
    parent bucket, or the rows of one finest bucket.
    """
    level_names = [f"__level_{i}" for i, _ in enumerate(levels)]
    rows = df.select("*", *(e.alias(n) for n, e in zip(level_names, levels.values())))
    rows = rows.select("*", *(e.alias(f"__value_{n}") for n, e in totals.items()))

    sums = {n: F.sum(f"__value_{n}").alias(f"__sum_{n}") for n in totals}
    offsets = rows.groupBy(*group, *level_names).agg(*sums.values())
    offsets = _with_prefixes(offsets, [*group, *level_names[:-1]], level_names[-1], totals, "__before_")
    for depth in range(len(level_names) - 1, 0, -1):
        parents, level = [*group, *level_names[: depth - 1]], level_names[depth - 1]
        step = offsets.groupBy(*parents, level).agg(*(F.sum(f"__sum_{n}").alias(f"__sum_{n}") for n in totals))
        step = _with_prefixes(step, parents, level, totals, "__prefix_").drop(*(f"__sum_{n}" for n in totals))
        offsets = offsets.join(step, [*parents, level]).withColumns(
            {f"__before_{n}": F.col(f"__before_{n}") + F.col(f"__prefix_{n}") for n in totals}
        )
        offsets = offsets.drop(*(f"__prefix_{n}" for n in totals))
    offsets = offsets.drop(*(f"__sum_{n}" for n in totals))

    within = (
        Window.partitionBy(*group, *level_names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = rows.join(offsets, [*group, *level_names])
    for n in totals:
        placed = placed.withColumn(n, F.col(f"__before_{n}") + F.sum(f"__value_{n}").over(within))
    return placed.drop(
        *level_names, *(f"__value_{n}" for n in totals), *(f"__before_{n}" for n in totals)
    )


def _bucketed_values(df: DataFrame, group: Sequence[str], value: str, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Counts per distinct non-null value, and per bucket the rows before it and in its group.

    Equal values collapse while combining on the map side, so a value that a
    third of all rows share costs one row per map task.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("__rows_at"))
        .withColumn("__bucket", bucket)
    )
    buckets = counted.groupBy(*group, "__bucket").agg(F.sum("__rows_at").alias("__bucket_rows"))
    upto = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = buckets.select(
        *group,
        "__bucket",
        (F.sum("__bucket_rows").over(upto) - F.col("__bucket_rows")).alias("__before"),
        "__bucket_rows",
        F.sum("__bucket_rows").over(Window.partitionBy(*group)).alias("group_rows"),
    )
    return counted, sizes


def _upto(group: Sequence[str], value: str) -> Column:
    inside = (
        Window.partitionBy(*group, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.col("__before") + F.sum("__rows_at").over(inside)


def order_statistics(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    picks: Mapping[str, Column],
    bucket: Column | Sequence[Column] | None = None,
) -> DataFrame:
    """Values at given 0-based positions of each group's sorted non-null values.

    ``picks`` maps an output name to a position in terms of ``group_rows``.
    ``bucket`` may be several functions of the value, coarse to fine. Values are
    counted per bucket, level by level and only inside the bucket that holds a
    wanted position, and only the values of one finest bucket are sorted. No
    window partition holds more than the buckets of one parent bucket, or the
    distinct values of one finest bucket.
    """
    group = list(group)
    levels = [magnitude_bucket(F.col(value))] if bucket is None else [bucket] if isinstance(bucket, Column) else list(bucket)
    names = [f"__level_{i}" for i in range(len(levels))]
    # Equal values collapse while combining on the map side.
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__rows"))
    counted = counted.withColumns(dict(zip(names, levels)))
    sizes = counted.groupBy(*group).agg(F.sum("__rows").alias("group_rows"))
    asked = F.array(*(F.struct(F.lit(n).alias("pick"), e.cast("long").alias("at")) for n, e in picks.items()))
    wanted = sizes.select(*group, F.explode(asked).alias("__asked")).select(*group, "__asked.*").filter("at is not null")
    for depth, name in enumerate(names):
        parent = [*group, *names[:depth]]
        totals = counted.groupBy(*parent, name).agg(F.sum("__rows").alias("__total"))
        wanted = _holding(totals.join(wanted, parent), [*parent, "pick"], name, "__total").drop("__total")
    found = _holding(counted.join(wanted, [*group, *names]), [*group, *names, "pick"], value, "__rows")
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("pick") == n, F.col(value))).alias(n) for n in picks))


def _holding(rows: DataFrame, parent: Sequence[str], order: str, total: str) -> DataFrame:
    """Of the rows of each parent, the one that holds position ``at``, which then counts from its start."""
    upto = Window.partitionBy(*parent).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__before", F.sum(total).over(upto) - F.col(total))
    inside = placed.filter((F.col("at") >= F.col("__before")) & (F.col("at") < F.col("__before") + F.col(total)))
    return inside.withColumn("at", F.col("at") - F.col("__before")).drop("__before")


def median(df: DataFrame, group: Sequence[str], value: str, output: str, bucket: Column | None = None) -> DataFrame:
    """Exact median per group; the mean of the middle two for an even count."""
    rows = F.col("group_rows")
    middle = order_statistics(
        df,
        group,
        value,
        {"__low": F.floor((rows - 1) / 2), "__high": F.floor(rows / 2)},
        bucket,
    )
    return middle.select(*group, ((F.col("__low") + F.col("__high")) / 2.0).alias(output))


def at_index_fraction(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    fraction: float,
    output: str,
    bucket: Column | Sequence[Column] | None = None,
    min_rows: int = 1,
) -> DataFrame:
    """The value at position ``min(n - 1, int(n * fraction))`` of each group of at least ``min_rows``."""
    rows = F.col("group_rows")
    position = F.when(rows >= min_rows, F.least(rows - 1, F.floor(rows * F.lit(fraction))))
    return order_statistics(df, group, value, {output: position}, bucket)


def percent_at_or_below(
    df: DataFrame, group: Sequence[str], value: str, output: str, bucket: Column | None = None
) -> DataFrame:
    """Add the percentage of the group's non-null values at or below the row's value."""
    bucket = magnitude_bucket(F.col(value)) if bucket is None else bucket
    counted, sizes = _bucketed_values(df.select(*group, value), list(group), value, bucket)
    ranks = counted.join(sizes, [*group, "__bucket"]).select(
        *group, value, (_upto(group, value) / F.col("group_rows") * 100.0).alias(output)
    )
    return join_dealt(df, ranks, [*group, value], "left")


def row_rank(
    df: DataFrame, group: Sequence[str], value: str, key: str, output: str, bucket: Column | None = None
) -> DataFrame:
    """Add a unique 0-based rank by value; ties are ordered by a hash of ``key``, then ``key``."""
    bucket = magnitude_bucket(F.col(value)) if bucket is None else bucket
    levels = {"bucket": bucket, "value": F.col(value), "tie": tie_bucket(key)}
    ranked = running_totals(df, group, levels, [key], {output: F.lit(1)})
    return ranked.withColumn(output, F.col(output) - 1)
