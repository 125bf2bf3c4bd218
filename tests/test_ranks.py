import datetime as dt
import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from railwatch.functions import ranks
from railwatch.operators import listings

VALUES = {
    "spread": lambda random, n: random.normal(0, 1e6, n),
    "tied": lambda random, n: random.integers(-2, 3, n).astype(float),
    "hot": lambda random, n: np.where(random.random(n) < 0.4, 7.25, random.lognormal(3, 2, n)),
    "small": lambda random, n: random.random(n) * 1e-3,
}


@pytest.fixture(params=VALUES)
def sample(request, spark):
    random = np.random.default_rng(7)
    rows = []
    for group, size in (("a", 501), ("b", 60), ("c", 1), ("d", 4)):
        rows += [(group, f"{group}{i}", float(v)) for i, v in enumerate(VALUES[request.param](random, size))]
    rows.append(("a", "null", None))
    grouped = defaultdict(list)
    for group, _key, v in rows:
        if v is not None:
            grouped[group].append(v)
    return spark.createDataFrame(rows, "g string, k string, v double"), {g: sorted(v) for g, v in grouped.items()}


def test_median(sample):
    df, groups = sample
    got = {r.g: r.m for r in ranks.median(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}


@pytest.mark.parametrize("fraction", [0.75, 0.8, 1.0])
def test_index_fraction(sample, fraction):
    df, groups = sample
    got = {r.g: r.m for r in ranks.at_index_fraction(df, ["g"], "v", fraction, "m").collect()}
    assert got == {g: v[min(len(v) - 1, int(len(v) * fraction))] for g, v in groups.items()}


def test_index_fraction_needs_enough_rows(sample):
    df, groups = sample
    got = {r.g for r in ranks.at_index_fraction(df, ["g"], "v", 0.8, "m", min_rows=5).collect()}
    assert got == {g for g, v in groups.items() if len(v) >= 5}


def test_percent_at_or_below(sample):
    df, groups = sample
    for row in ranks.percent_at_or_below(df, ["g"], "v", "p").collect():
        if row.v is None:
            assert row.p is None
        else:
            below = sum(1 for v in groups[row.g] if v <= row.v)
            assert row.p == pytest.approx(100 * below / len(groups[row.g]))


def test_row_rank_is_a_permutation_in_value_order(sample):
    df, groups = sample
    ranked = ranks.row_rank(df.filter("v IS NOT NULL"), ["g"], "v", "k", "r").collect()
    for group, values in groups.items():
        rows = sorted((r for r in ranked if r.g == group), key=lambda r: r.r)
        assert [r.r for r in rows] == list(range(len(values)))
        assert [r.v for r in rows] == values


def test_row_rank_does_not_depend_on_partitioning(sample):
    df, _ = sample
    df = df.filter("v IS NOT NULL")
    one = {r.k: r.r for r in ranks.row_rank(df.coalesce(1), ["g"], "v", "k", "r").collect()}
    many = {r.k: r.r for r in ranks.row_rank(df.repartition(5, "v"), ["g"], "v", "k", "r").collect()}
    assert one == many


def test_buckets_keep_the_order(spark):
    values = [-1e12, -3.5, -0.1, 0.0, 1e-9, 0.5, 1.0, 1.5, 99.99, 100.0, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r.b for r in df.select("v", ranks.magnitude_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_running_totals(spark):
    random = np.random.default_rng(3)
    rows = [("g", int(a), int(b), i, float(x)) for i, (a, b, x) in enumerate(zip(random.integers(0, 4, 80), random.integers(0, 3, 80), random.integers(1, 9, 80)))]
    df = spark.createDataFrame(rows, "g string, a int, b int, i int, x double")
    got = ranks.running_totals(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, ["i"], {"s": F.col("x"), "n": F.lit(1)})
    total = 0.0
    for number, row in enumerate(sorted(got.collect(), key=lambda r: (r.a, r.b, r.i)), 1):
        total += row.x
        assert (row.s, row.n) == (total, number)


def test_positions_by_levels_equal_sorting(spark):
    """All instants of a group on one day, some in one second."""
    draw = random.Random(9)
    base = dt.datetime(2024, 3, 1)
    rows = []
    for group in ("a", "b", "c"):
        for _ in range(300 if group != "c" else 3):
            seconds = draw.choice([0, 5, 5, 5, 86_399, draw.randrange(86_400)])
            rows.append((group, base + dt.timedelta(days=draw.randrange(2) if group == "b" else 0, seconds=seconds, microseconds=draw.randrange(4))))
    rows += [("a", None), ("d", None)]
    table = spark.createDataFrame(rows, "g string, t timestamp")
    picks = {"low": F.floor(F.col("group_rows") * 0.2), "high": F.when(F.col("group_rows") > 5, F.col("group_rows") - 1)}
    found = ranks.order_statistics(table, ["g"], "t", picks, ranks.instant_levels(F.col("t"))).collect()
    for r in found:
        times = sorted(t for g, t in rows if g == r.g and t is not None)
        assert r.low == times[int(len(times) * 0.2)] and r.high == (times[-1] if len(times) > 5 else None)
    assert {r.g for r in found} == {"a", "b", "c"}


def test_no_window_holds_a_whole_day(spark, monkeypatch):
    """Sorted at once: the days, the seconds of one day, or the instants of one second."""
    largest = []
    holding = ranks._holding
    monkeypatch.setattr(ranks, "_holding", lambda rows, parent, *rest: largest.append(rows.groupBy(*parent).count().agg(F.max("count")).first()[0]) or holding(rows, parent, *rest))
    table = spark.range(50_000).select(F.lit("g").alias("g"), F.timestamp_micros(F.col("id") * 173_000).alias("t"))
    cut = ranks.at_index_fraction(table, ["g"], "t", 0.8, "cut", ranks.instant_levels(F.col("t"))).first().cut
    assert cut == table.filter("id = 40000").first().t
    assert largest[0] == 1 and largest[1] <= 86_400 and largest[1] < 50_000 and largest[2] <= 6


@pytest.mark.parametrize("offset", [0, 3, 95, 119, 150, 178, 180, 500])
def test_pages_of_counted_ranges_equal_sorting_all(spark, offset):
    rows = spark.range(180).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 40).alias("k"))
    order = [F.asc_nulls_first("k"), F.desc("id")]
    whole = [tuple(r) for r in rows.orderBy(*order).collect()]
    got = listings.page(rows, order, 25, offset, F.floor(F.col("k") / 7))
    assert got.total == 180 and [tuple(r) for r in got.rows.collect()] == whole[offset : offset + 25]
    assert listings.page(rows.limit(0), order, 25, offset, F.floor(F.col("k") / 7)).total == 0
