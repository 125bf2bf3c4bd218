"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    cursor = connection.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bands_of_the_weighted_score_reach_later_tables(spark):
    jobs = entry.queries()
    bands = [(r.snapshot_id, r.anomaly_band) for r in jobs["final_scores"](spark, FOLDER).collect()]
    rows = jobs["fully_scored_health"](spark, FOLDER).collect()
    for column, band in (("critical_anomaly_count", "Critical"), ("high_anomaly_count", "High")):
        found = {r.tenant_bank_id: r[column] for r in rows}
        assert found == {t: sum(s.startswith(f"{t}|") and b == band for s, b in bands) for t in found}
    fraud = [r for r in jobs["fully_scored_cases"](spark, FOLDER).collect() if r.category.startswith("FRAUD_")]
    flagged = sum(b in ("High", "Critical") for _, b in bands)
    assert sum(r.contributing_alerts_count for r in fraud) == flagged > 0
