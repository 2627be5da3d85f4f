import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import deals
from bazaarlens.sources import adapters as A
from bazaarlens.sources import buckets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_history_moves_no_rows(spark, sf, no_broadcast):
    history = buckets.bucketed(A.price_history(spark, sf), "offer_id", "history")
    current = lambda h: h.groupBy("offer_id").agg(F.max_by("price", F.struct("checked_at", "price")).alias("current_price"))
    got = deals.history_analysis(current(history), history)
    assert "Exchange" not in plan(got) and "Bucketed: true" in plan(got)
    plain = A.price_history(spark, sf)
    assert sorted(got.collect()) == sorted(deals.history_analysis(current(plain), plain).collect())


def test_offers_stay_where_they_are(spark, sf, no_broadcast):
    """Only the side of variants is moved to the offers; their own side has no exchange below the join."""
    offers = buckets.bucketed(A.offers(spark, sf), "product_variant_id", "offers", buckets=8)
    args = A.canonical_products(spark, sf), A.product_matches(spark, sf), A.variants(spark, sf)
    got = deals.offer_groups(*args, offers)
    above = plan(got).partition("Bucketed: true")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    chain, at = [], depth(above[-1])
    for line in reversed(above[:-1]):
        if depth(line) < at:
            chain, at = [*chain, line], depth(line)
    assert any("SortMergeJoin" in x for x in chain) and not any("Exchange" in x for x in chain)
    assert sorted(got.collect()) == sorted(deals.offer_groups(*args, A.offers(spark, sf)).collect())


def test_look_up_reads_the_buckets_of_its_keys(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
    table = buckets.bucketed(rows, "id", "links", buckets=64)
    for keys, most in ((["7"], 1), (["7", None, "no such key"], 2), ([str(k) for k in range(20)], 20)):
        found = buckets.of_keys(table, "id", keys)
        shown = plan(found.groupBy("id").agg(F.min("v")))  # as the feed does it
        read = int(shown.partition("SelectedBucketsCount: ")[2].split()[0])
        assert 1 <= read <= most and "out of 64" in shown and "Exchange" not in shown
        assert sorted(r.id for r in found.collect()) == sorted(k for k in keys if k and k.isdigit())
    assert buckets.of_keys(table, "id", []).count() == 0 == buckets.of_keys(table, "id", [None]).count()


def test_a_hot_key_makes_no_bucket(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit("x").alias("bucket"), F.col("id").alias("n"))
    assert not buckets.is_even(rows, "k", 64, always=100) and buckets.is_even(rows, "n", 64, always=100) and buckets.is_even(rows, "k", 64)
    kept = buckets.bucketed(rows, "k", "hot", buckets=64, always=100)
    assert "Bucketed: true" not in plan(kept.groupBy("k").count()) and sorted(kept.collect()) == sorted(rows.collect())


def test_null_keys_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 2), ("", 3)], "k string, v int")
    assert sorted(map(repr, buckets.bucketed(rows, "k", "odd").collect())) == sorted(map(repr, rows.collect()))
    empty = buckets.bucketed(rows.where("false"), "k", "none")
    assert empty.columns == ["k", "v"] and empty.count() == 0 and buckets.of_keys(empty, "k", ["a"]).count() == 0
