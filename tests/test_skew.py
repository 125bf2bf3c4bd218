import pytest
from pyspark.sql import functions as F

from railwatch.functions import ranks, skew
from railwatch.operators import identity, lookup


def lopsided(spark, n=9000):
    """A third of all rows under one key, a sixth without a key, the others under keys of their own."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 6 != 1, F.concat(F.lit("k"), F.col("id") % 3000))
    return spark.range(n).select("id", key.alias("key"), F.lit("t").alias("tenant"))


def others(spark):
    rows = [("hot", "t", 1), ("hot", "t", 2), (None, "t", 3), ("none", "t", 4), *((f"k{i}", "t", i) for i in range(0, 3000, 7))]
    return spark.createDataFrame(rows, "key string, tenant string, value int")


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_join_equals_a_plain_one(spark, how):
    rows, right = lopsided(spark), others(spark)
    plain = rows.join(right, ["tenant", "key"], how)
    for deal_rows in (100, 10**6):
        dealt = skew.join_dealt(rows, right, ["tenant", "key"], how, deal_rows)
        assert dealt.columns == plain.columns and rows_of(dealt) == rows_of(plain)


def test_full_joins_are_refused(spark):
    with pytest.raises(ValueError, match="told twice"):
        skew.join_dealt(lopsided(spark), others(spark), ["tenant", "key"], "full_outer")


def test_only_frequent_keys_are_found(spark):
    found = skew.frequent_keys(lopsided(spark), ["tenant", "key"], 200)
    hot, none = (spark.range(1).select(F.xxhash64(F.lit("t"), F.lit(k).cast("string"))).first()[0] for k in ("hot", None))
    assert found == {hot: 15, none: 8}
    assert skew.frequent_keys(lopsided(spark).limit(0), ["tenant", "key"], 200) == {}


def test_no_task_holds_twice_the_median(spark, monkeypatch):
    """One key with a third of all rows, shuffled joins only."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("-1", "false", "8")):
            spark.conf.set(key, value)
        rows, right = lopsided(spark, 90_000), others(spark)

        def sizes(df):
            return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())

        dealt = sizes(skew.join_dealt(rows, right, ["tenant", "key"], "left", 300))
        plain = sizes(rows.join(right, ["tenant", "key"], "left"))
        assert sum(dealt) == sum(plain)
        assert dealt[-1] < 2 * dealt[len(dealt) // 2] < plain[-1]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_ranks_with_a_frequent_value(spark, monkeypatch):
    rows = spark.range(2000).select("id", F.lit("g").alias("g"), F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, 5.0).otherwise(F.col("id") * 1.0)).alias("v"))
    whole = rows_of(ranks.percent_at_or_below(rows, ["g"], "v", "rank"))
    monkeypatch.setattr(skew, "DEAL_ROWS", 50)
    assert rows_of(ranks.percent_at_or_below(rows, ["g"], "v", "rank")) == whole


def test_known_ids_of_a_frequent_party(spark, make_events, monkeypatch):
    events = make_events(*({"source_merchant_id": "HOT" if i % 3 else f"M{i}"} for i in range(300)), {"source_merchant_id": None})
    known = spark.createDataFrame([("BANK", "HOT", "MER-OLD"), ("BANK", "M3", "MER-3")], "tenant_bank_id string, source_merchant_id string, merchant_id string")
    whole = rows_of(identity.resolve_events(events, known).select("transaction_id", "merchant_id"))
    assert sum(m == "MER-OLD" for m, _ in whole) == 200
    monkeypatch.setattr(skew, "DEAL_ROWS", 20)
    dealt = identity.resolve_events(events, known)
    assert rows_of(dealt.select("transaction_id", "merchant_id")) == whole and dealt.columns == events.columns


def test_events_of_a_frequent_batch(spark, make_events, monkeypatch):
    events = make_events(*({"batch_id": "HOT" if i % 3 else f"B{i}", "merchant_id": f"M{i % 5}"} for i in range(300)))
    issues = spark.createDataFrame(
        [("I1", "BATCH_NOT_SETTLED", "BANK", "BATCH", "HOT"), ("I2", "BATCH_NOT_SETTLED", "BANK", "BATCH", "B3"), ("I3", "DUPLICATE_PAYMENT", "BANK", "TRANSACTION", "T4")],
        "issue_id string, issue_type string, tenant_bank_id string, reference_type string, reference_id string",
    )
    whole = rows_of(lookup.issue_events(issues, events))
    assert len(whole) == 202
    monkeypatch.setattr(skew, "DEAL_ROWS", 20)
    assert rows_of(lookup.issue_events(issues, events)) == whole
