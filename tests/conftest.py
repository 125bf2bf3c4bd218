import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from railwatch.schema import MAPPED_FIELDS  # noqa: E402
from railwatch.session import prepare  # noqa: E402

EVENT_SCHEMA = ", ".join(
    ["tenant_bank_id string", "rail_type string", "transaction_id string", "event_ordinal long"]
    + [f"{name} {kind.simpleString()}" for name, kind in MAPPED_FIELDS.items()]
    + ["first_seen_at timestamp", "last_updated_at timestamp"]
)
EVENT_COLUMNS = ["tenant_bank_id", "rail_type", "transaction_id", "event_ordinal", *MAPPED_FIELDS, "first_seen_at", "last_updated_at"]
SEEN = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("railwatch-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def make_events(spark):
    """Canonical events from dicts of the fields that matter to a test."""

    def make(*rows):
        defaults = {"tenant_bank_id": "BANK", "rail_type": "ACH", "first_seen_at": SEEN, "last_updated_at": SEEN}
        full = []
        for number, row in enumerate(rows):
            values = {**defaults, "transaction_id": f"T{number}", "event_ordinal": number, **row}
            full.append(tuple(values.get(c) for c in EVENT_COLUMNS))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return make


def by(df, *keys):
    """Rows of a small result as dicts, found by the values of ``keys``."""
    rows = [row.asDict(recursive=True) for row in df.collect()]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
