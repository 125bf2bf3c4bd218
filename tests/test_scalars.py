import datetime as dt

import pytest
from pyspark.sql import functions as F

from railwatch.functions import dates, scalars


def value(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"c {kind}").select(column(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, expected",
    [(" complete ", "SETTLED"), ("in progress", "PENDING"), ("Returned", "FAILED"), ("on hold", "ON_HOLD")],
)
def test_status(spark, text, expected):
    assert value(spark, scalars.normalized_status, text) == expected


@pytest.mark.parametrize("text, expected", [(" 12345678 ", "****5678"), ("12", "****12")])
def test_mask(spark, text, expected):
    assert value(spark, scalars.masked_last4, text) == expected


@pytest.mark.parametrize("text, expected", [("Yes", True), (" 0 ", False), ("maybe", None)])
def test_boolean(spark, text, expected):
    assert value(spark, scalars.to_boolean, text) is expected


@pytest.mark.parametrize("text, expected", [("1_000.5", 1000.5), (" -3e2", -300.0), ("12,5", None), ("1d", None), ("", None)])
def test_number(spark, text, expected):
    assert value(spark, scalars.to_number, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-03T10:00:00Z", dt.datetime(2024, 1, 3, 10)),
        ("2024-01-03 10:00:00", dt.datetime(2024, 1, 3, 10)),
        ("2024-01-03", dt.datetime(2024, 1, 3)),
        ("2024-01-03T10:00:00+05:30", dt.datetime(2024, 1, 3, 4, 30)),
        ("2024-01-03T10:00:00.123456789Z", dt.datetime(2024, 1, 3, 10)),
        ("20240103T100000Z", dt.datetime(2024, 1, 3, 10)),
        ("20240103T1000+0530", dt.datetime(2024, 1, 3, 4, 30)),
        ("2024-01-03T10", dt.datetime(2024, 1, 3, 10)),
        ("2024-01-03T10:00:00+01", dt.datetime(2024, 1, 3, 9)),
        ("20240103", dt.datetime(2024, 1, 3)),
        ("2024-0103", None),
        ("2024-01-03T10:0000", None),
        ("2024", None),
        ("soon", None),
        ("2024-13-03", None),
    ],
)
def test_iso(spark, text, expected):
    got = value(spark, lambda c: F.date_format(scalars.parse_iso(c), "yyyy-MM-dd HH:mm:ss"), text)
    assert got == (expected and expected.strftime("%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-10T10:00:00Z", "2024-01-08 00:00:00"),
        # Monday 02:00 in its own zone is still Sunday in UTC.
        ("2024-01-08T02:00:00+05:00", "2024-01-07 19:00:00"),
        ("2024-01-07", "2024-01-01 00:00:00"),
    ],
)
def test_week_starts_on_the_own_clock(spark, text, expected):
    got = value(spark, lambda c: F.date_format(scalars.local_week_start(c), "yyyy-MM-dd HH:mm:ss"), text)
    assert got == expected


def test_map_suffix(spark):
    row = spark.createDataFrame([({"a.other": "1", "x.response_time_ms": "7"}, {})], "m map<string,string>, e map<string,string>")
    found = row.select(
        scalars.map_value_by_suffix(F.col("m"), ".response_time_ms").alias("m"),
        scalars.map_value_by_suffix(F.col("e"), ".response_time_ms").alias("e"),
    ).first()
    assert (found.m, found.e) == ("7", None)


@pytest.mark.parametrize(
    "band, score, expected",
    [
        (scalars.anomaly_band, 29.99, "Normal"),
        (scalars.anomaly_band, 60.0, "High"),
        (scalars.anomaly_band, 80.0, "Critical"),
        (scalars.priority_level, 85.0, "Critical"),
        (scalars.priority_level, 34.9, "Low"),
        (scalars.health_band, 70.0, "Watch"),
        (scalars.health_band, 49.9, "Critical"),
        (scalars.observation_tier, 50.0, "ENTITY_SPECIFIC"),
        (scalars.observation_tier, 200.0, "ENTITY_SPECIFIC"),
        (scalars.observation_tier, 201.0, "FULL_MODEL"),
        (scalars.drift_scale, 7.0, 100.0),
        (scalars.timeout_severity, -2.0, 40.0),
    ],
)
def test_bands(spark, band, score, expected):
    assert value(spark, band, score, "double") == expected


def test_percent_share(spark):
    rows = spark.createDataFrame([(5.0, 2.0), (1.0, 0.0), (1.0, 8.0)], "v double, t double")
    assert [r.p for r in rows.select(scalars.percent_share(F.col("v"), F.col("t")).alias("p")).collect()] == [100.0, None, 12.5]


def test_titles(spark):
    row = spark.createDataFrame([("DUPLICATE_PAYMENT", "ACH"), ("FRAUD_HIGH", None)], "c string, r string")
    cols = row.select(scalars.case_title(F.col("c"), F.col("r")).alias("t"), scalars.pattern_title(F.col("c"), F.col("r")).alias("p"))
    assert [tuple(r) for r in cols.collect()] == [
        ("ACH Duplicate payment Cluster", "ACH Duplicate payment"),
        ("Fraud High Cluster", "High anomaly cluster"),
    ]


def test_day_window(spark):
    rows = spark.createDataFrame(
        [("2024-01-08T00:00:00Z",), ("2024-01-14T23:59:59Z",), ("2024-01-15T00:00:00Z",), (None,)], "t string"
    )
    start, end = dt.date(2024, 1, 8), dt.date(2024, 1, 14)
    flags = rows.select(
        dates.text_in_range(F.col("t"), start, end).alias("text"),
        dates.day_in_range(scalars.parse_iso(F.col("t")), start, end).alias("day"),
        dates.day_in_range(scalars.parse_iso(F.col("t")), None, None).alias("all"),
    ).collect()
    assert [bool(r.text) for r in flags] == [True, True, False, False]
    assert [r.day for r in flags] == [True, True, False, False]
    assert all(r["all"] for r in flags)
