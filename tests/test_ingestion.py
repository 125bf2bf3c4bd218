import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from conftest import by
from railwatch.sources import files, layouts, mapping, merge, tables
from railwatch.sources.layouts import DIRECT, JSON_MERGE, NORMALIZE_ENUM, Mapping

AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
PRE = "wire_ref,debtor_name,instructed_amount,ofac_screen_result,wire_status,business_id\nW1,Ann,10.5,CLEAR,INITIATED,B1\nW2,Bob,n/a,,INITIATED,B2\nW3,Cy,oops,HIT,INITIATED,B3\n,Di,1,CLEAR,INITIATED,B4\n"
POST = "wire_ref ,debtor_name,settled_amount,wire_fee,aml_screen_result,wire_status,internal_batch_id\nW1,,11.5,0.25,CLEAR,Completed,X\nW4,Ed,4,,HIT,weird status,Y\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_layouts_cover_every_rail():
    nested = layouts.nested_layout("B")
    assert {m.rail_type for m in nested} == set(layouts.RAILS)
    assert len(set(nested)) == len(nested)
    shared = layouts.shared_layout("B")
    assert sum(m.canonical_field_name == "processor_name" for m in shared) == 1
    assert len(layouts.flat_layout("B")) == 22
    counts = [Counter(m.rail_type for m in rows) for rows in (nested, shared, layouts.flat_layout("B"))]
    assert counts == [
        {"CHEQUE": 74, "ACH": 74, "WIRE": 70, "FEDNOW": 79, "CARD": 66},
        {"CHEQUE": 25, "ACH": 25, "WIRE": 25, "FEDNOW": 25, "CARD": 26},
        {"WIRE": 14, "CARD": 8},
    ]


def test_csv_is_read_as_trimmed_text_with_nulls(spark, tmp_path):
    df = files.read_delimited(spark, write(tmp_path / "post.csv", POST))
    assert files.source_columns(df)[0] == "wire_ref"
    rows = df.orderBy(files.POSITION).collect()
    assert [r.wire_ref for r in rows] == ["W1", "W4"]
    assert rows[0].debtor_name is None and rows[0].settled_amount == "11.5"


def test_quotes_and_line_ends_in_cells(spark, tmp_path):
    text = 'id,name,amount\nT1,"Smith ""Bob"", Ltd",5\nT2,"two\nlines",6\n'
    rows = files.read_delimited(spark, write(tmp_path / "quoted.csv", text)).orderBy(files.POSITION).collect()
    assert [(r.id, r.name, r.amount) for r in rows] == [("T1", 'Smith "Bob", Ltd', "5"), ("T2", "two\nlines", "6")]


def test_later_files_merge_into_known_events(spark, tmp_path):
    table = mapping.mapping_table(spark, layouts.flat_layout("BANK"))
    pre, post = write(tmp_path / "pre.csv", PRE), write(tmp_path / "post.csv", POST)
    order = [("BANK", "WIRE", "PRE", pre), ("BANK", "WIRE", "POST", post)]
    whole = by(merge.ingest_files(spark, table, order, AT), "transaction_id")
    later = AT + dt.timedelta(days=1)
    known = merge.ingest_files(spark, table, order[:1], AT)
    both = by(merge.ingest_files(spark, table, order[1:], later, existing=known), "transaction_id")
    assert both.keys() == whole.keys()
    for key, row in whole.items():
        same = ("payer_name", "amount", "fees", "status", "risk_flags", "snapshot_pre", "snapshot_post")
        assert [both[key][c] for c in same] == [row[c] for c in same]
    assert both["W2"]["event_ordinal"] == whole["W2"]["event_ordinal"]
    assert both["W1"]["first_seen_at"] < both["W1"]["last_updated_at"]
    assert both["W2"]["first_seen_at"] == both["W2"]["last_updated_at"]


def test_map_entries_of_an_earlier_configuration_stay(spark, tmp_path):
    table = mapping.mapping_table(spark, layouts.flat_layout("BANK"))
    known = merge.ingest_files(spark, table, [("BANK", "WIRE", "PRE", write(tmp_path / "pre.csv", PRE))], AT)
    flags = F.when(F.col("transaction_id") == "W1", F.create_map(F.lit("retired"), F.lit("x"))).otherwise(F.col("risk_flags"))
    known = known.withColumn("risk_flags", flags)
    post = [("BANK", "WIRE", "POST", write(tmp_path / "post.csv", POST))]
    merged = by(merge.ingest_files(spark, table, post, AT, existing=known), "transaction_id")
    assert merged["W1"]["risk_flags"] == {"retired": "x", "aml_screen_result": "CLEAR"}


def test_an_empty_condition_is_none(spark, tmp_path):
    raw = files.read_delimited(spark, write(tmp_path / "pre.csv", PRE))
    rows = [Mapping("B", "WIRE", "wire_ref", "transaction_id", DIRECT, "", "ignored")]
    assert mapping.good_rows(mapping.project(raw, rows)).count() == 3


def test_files_merge_into_canonical_events(spark, tmp_path):
    table = mapping.mapping_table(spark, layouts.flat_layout("BANK"))
    pre, post = write(tmp_path / "pre.csv", PRE), write(tmp_path / "post.csv", POST)
    order = [("BANK", "WIRE", "PRE", pre), ("BANK", "WIRE", "POST", post)]
    forward = by(merge.ingest_files(spark, table, order, AT), "transaction_id")
    assert set(forward) == {"W1", "W2", "W4"}
    one = forward["W1"]
    assert (one["payer_name"], one["amount"], one["fees"], one["status"]) == ("Ann", 11.5, 0.25, "SETTLED")
    assert one["risk_flags"] == {"ofac_screen_result": "CLEAR", "aml_screen_result": "CLEAR"}
    assert one["snapshot_pre"]["debtor_name"] == "Ann" and one["snapshot_post"]["internal_batch_id"] == "X"
    assert forward["W2"]["amount"] is None and forward["W2"]["risk_flags"] is None
    assert forward["W4"]["status"] == "WEIRD_STATUS" and forward["W4"]["snapshot_pre"] is None

    backward = by(merge.ingest_files(spark, table, order[::-1], AT), "transaction_id")
    assert backward["W1"]["payer_name"] == "Ann" and backward["W1"]["fees"] == 0.25
    assert backward["W1"]["risk_flags"] == one["risk_flags"]
    again = by(merge.ingest_files(spark, table, order + order, AT), "transaction_id")
    for key, row in forward.items():
        assert {k: v for k, v in again[key].items() if k != "event_ordinal"} == {k: v for k, v in row.items() if k != "event_ordinal"}


def test_bad_rows_are_set_aside(spark, tmp_path):
    mappings = [m for m in layouts.flat_layout("BANK") if m.rail_type == "WIRE"]
    raw = files.read_delimited(spark, write(tmp_path / "pre.csv", PRE))
    projected = mapping.project(raw, mappings)
    errors = sorted(r.error for r in mapping.failed_rows(projected).collect())
    assert errors == ["not a number: oops", "the mapping gives this row no transaction_id"]
    log = mapping.ingestion_log(projected, raw, mappings, "BANK", "WIRE", "PRE", "pre.csv").first()
    assert (log.row_count, log.rows_mapped, log.rows_failed, log.unmapped_columns) == (4, 2, 2, [])


def _project(spark, mappings, rows, columns):
    schema = ", ".join(f"{c} string" for c in columns)
    raw = spark.createDataFrame(rows, schema).withColumn(files.POSITION, F.struct(F.lit(0).alias("block"), F.monotonically_increasing_id().alias("row")))
    return mapping.project(raw, mappings).orderBy(files.POSITION).collect()


def test_conditions_and_last_mapping(spark):
    mappings = [
        Mapping("B", "ACH", "id", "transaction_id"),
        Mapping("B", "ACH", "who", "source_merchant_id", DIRECT, "kind", "MERCHANT"),
        Mapping("B", "ACH", "who", "source_individual_id", DIRECT, "kind", "INDIVIDUAL"),
        Mapping("B", "ACH", "a", "amount"),
        Mapping("B", "ACH", "b", "amount"),
        Mapping("B", "ACH", "flag", "is_retry"),
        Mapping("B", "ACH", "st", "status", NORMALIZE_ENUM),
        Mapping("B", "ACH", "odd", "currency", "REVERSE"),
        Mapping("B", "ACH", "r1", "risk_flags", JSON_MERGE),
        Mapping("B", "ACH", "absent", "fees"),
    ]
    columns = ["id", "who", "kind", "a", "b", "flag", "st", "odd", "r1"]
    rows = [
        ("1", "X", "MERCHANT", "1", "2", "yes", "posted", None, "v"),
        ("2", "Y", "INDIVIDUAL", "1", None, "n", None, None, None),
        ("3", "Z", None, "1", "2", "perhaps", None, None, None),
        ("4", "Z", None, "1", "2", None, None, "EUR", None),
    ]
    one, two, three, four = _project(spark, mappings, rows, columns)
    assert (one.source_merchant_id, one.source_individual_id, one.amount, one.is_retry, one.status) == ("X", None, 2.0, True, "SETTLED")
    assert one.risk_flags == {"r1": "v"} and one.fees is None and one.error is None
    assert (two.source_merchant_id, two.source_individual_id, two.amount, two.is_retry) == (None, "Y", None, False)
    assert two.risk_flags == {}
    assert three.error == "not a boolean: perhaps"
    assert four.error == "no such transform: REVERSE"


def test_reseed_replaces_and_add_missing_adds(spark):
    old = mapping.mapping_table(spark, layouts.flat_layout("A") + layouts.flat_layout("B"))
    new = mapping.mapping_table(spark, [Mapping("A", "ACH", "id", "transaction_id"), Mapping("B", "WIRE", "wire_ref", "transaction_id")])
    replaced = mapping.reseed(old, new.filter("tenant_bank_id = 'A'"))
    assert replaced.filter("tenant_bank_id = 'A'").count() == 1
    assert replaced.filter("tenant_bank_id = 'B'").count() == 22
    assert mapping.add_missing(old, new).count() == old.count() + 1
    assert len(mapping.load_mappings(old, "B", "CARD")) == 8


def test_split_by_rail(spark, tmp_path):
    rows = spark.createDataFrame([("ACH", "PRE", 1), ("CARD", "POST", 2)], "rail string, stage string, v int")
    files.write_by_rail(rows, str(tmp_path / "split"))
    assert (tmp_path / "split" / "rail=ACH" / "stage=PRE").exists()


def test_scope_replace_clears_what_is_gone(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "tenant_bank_id string, v int")
    tables.replace_scope(rows, path)
    tables.replace_scope(rows.filter("v > 9"), path, "A")
    left = spark.read.schema(rows.schema).parquet(path).collect()
    assert [(r.tenant_bank_id, r.v) for r in left] == [("B", 2)]
    tables.replace_scope(rows, path, "A")
    assert spark.read.parquet(path).count() == 2


def test_log_keeps_history_and_gives_the_latest(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "k string, at int, v string"
    assert tables.read_or_empty(spark, path, schema).count() == 0
    tables.append(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), path)
    tables.append(spark.createDataFrame([("a", 2, "z")], schema), path)
    latest = tables.latest_by_key(spark.read.parquet(path), ["k"], "at")
    assert {r.k: r.v for r in latest.collect()} == {"a": "z", "b": "y"}


def test_records_over_many_splits_equal_the_whole_file_reader(spark, tmp_path):
    """Quoted line ends at the edges of splits, over several splits, and in the last record."""
    draw = random.Random(4)
    cells = ["plain", '"a\nb"', '"say ""x"""', '"\n\n"', '""', "", '"c,d"', '"' + "long\n" * 60 + '"', '"e\r\nf"']
    lines = ["id,one,two"] + [f"{i},{draw.choice(cells)},{draw.choice(cells)}" for i in range(400)]
    path = write(tmp_path / "broken.csv", "\n".join([*lines[:200], "", *lines[200:]]) + "\n")
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
    want = [tuple(None if c in files.NULL_TEXTS else c for c in r) for r in spark.read.csv(path, **options).collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300", "1111", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            splits = spark.read.text(path).rdd.getNumPartitions()
            assert (splits > 10) == (size != "100000")
            got = files.read_delimited(spark, path).orderBy(files.POSITION).drop(files.POSITION).collect()
            assert [tuple(r) for r in got] == want and len(want) == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
