"""The price tables, read from the order-processing tables: suppliers are merchants, parts are products,
line items are offers and events are price snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in as many parts as a shuffle has, by a key: a small file is read by few tasks, and what is made of its
    rows (pages that Python parses) may be dear."""
    return rows.repartition(max(200, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def merchants(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    return s.select(key.alias("id"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_name")).alias("name"), F.concat(F.lit("shop-"), key).alias("slug"), F.concat(F.lit("shop"), key, F.lit(".example")).alias("domain"), (F.col("s_acctbal") > -900).alias("active"))


def products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    title = F.concat_ws(" ", F.initcap("p_name"), F.initcap("p_type"), F.concat(F.col("p_size") * 20, F.lit("ml")))
    return p.select(key.alias("id"), F.col("p_brand").alias("brand"), title.alias("title"), F.lower(title).alias("normalized_title"), F.lit(None).cast("string").alias("image_url"), F.concat(F.lit("part-"), key).alias("slug"), F.lit(True).alias("active"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        F.concat(F.lit("v-"), key).alias("id"), key.alias("product_id"), F.lpad((F.col("p_partkey") * 7919 + 100_000).cast("string"), 13, "0").alias("gtin"), F.concat(F.lit("part:"), key).alias("sku"),
        F.lit(None).cast("string").alias("image_url"), (F.col("p_partkey") % 50 != 49).alias("active"),
    )


def offers(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return i.select(
        ident.alias("id"), F.concat(F.lit("v-"), F.col("l_partkey").cast("string")).alias("product_variant_id"), F.col("l_suppkey").cast("string").alias("merchant_id"), F.col("l_partkey").cast("string").alias("merchant_product_id"),
        F.concat(F.lit("https://shop.example/"), ident).alias("product_url"), (F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).alias("price"), F.lit("TRY").alias("currency"),
        (F.col("l_returnflag") != "R").alias("in_stock"), F.lit(None).cast("string").alias("image_url"), F.col("l_shipdate").alias("last_checked_at"), F.col("l_shipdate").alias("updated_at"),
    )


def price_history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("offer_id"), F.col("value").alias("price"), (F.col("event_type") != "error").alias("in_stock"), F.col("ts").alias("checked_at"))


def canonical_products(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).select("id", "brand", "title", "normalized_title", F.lit(None).cast("int").alias("capacity_ml"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("gtin"), (F.col("id").cast("long") % 20 != 19).alias("active"), F.lit(None).cast("timestamp").alias("updated_at"))


def product_matches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        F.concat(F.lit("m-"), key).alias("id"), key.alias("canonical_product_id"), key.alias("product_id"), F.lit(99.0).alias("match_score"), F.lit("gtin").alias("match_reason"),
        F.when(F.col("p_partkey") % 30 == 29, "rejected").otherwise("approved").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


def deal_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Deals of an earlier run: every third part has one, with the state of the order of the same number."""
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0").join(table(spark, d, "part").select(F.col("p_partkey").alias("o_orderkey")), "o_orderkey")
    key, none = F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    return o.select(
        F.concat(F.lit("deal-"), key).alias("id"), key.alias("canonical_product_id"), none.alias("cheapest_offer_id"), none.alias("cheapest_merchant_id"), F.col("o_totalprice").alias("cheapest_price"), none.alias("competitor_offer_id"),
        none.alias("competitor_merchant_id"), F.col("o_totalprice").alias("competitor_price"), F.lit(0.0).alias("gap_percent"), F.lit(15.0).alias("threshold_percent"), F.when(F.col("o_orderstatus") == "F", "expired").otherwise("candidate").alias("status"),
        F.col("o_orderdate").alias("detected_at"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") == "O").alias("verified"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")).alias("verified_at"),
        F.lit("no_observed_drop").alias("history_status"), F.lit(2).alias("history_points"), F.lit(1.0).alias("history_avg_30d"), F.lit(1.0).alias("history_low_90d"), F.lit(None).cast("double").alias("previous_distinct_price"),
        F.lit(0.0).alias("history_drop_percent"), F.lit(5.0).alias("history_threshold_percent"),
    )


def all_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {f.__name__: f(spark, d) for f in (merchants, products, offers, price_history, canonical_products, product_matches, deal_candidates)} | {"product_variants": variants(spark, d)}
