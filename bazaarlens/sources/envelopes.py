"""Results of searches as JSON: one object for each search, with its items and whether there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "merchant string, ok boolean, query string, count long, products array<struct<merchant_product_id string, brand string, title string, price double, image_url string, product_url string, in_stock boolean, gtin string>>"


def envelopes(searches: DataFrame, items: DataFrame) -> DataFrame:
    """``(merchant, ok, query, count, products)`` for each of (merchant, query); items are as many as a
    search's limit, so a list stays short. A search without items has an empty list and is not ok."""
    fields = ["merchant_product_id", "brand", "title", "price", "image_url", "product_url", "in_stock", "gtin"]
    held = items.groupBy("merchant", "query").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("products"))
    rows = searches.select("merchant", "query").distinct().join(held, ["merchant", "query"], "left").withColumn("products", F.coalesce("products", F.array()))
    return rows.select("merchant", (F.size("products") > 0).alias("ok"), "query", F.size("products").cast("long").alias("count"), "products")


def write_envelopes(rows: DataFrame, path: str) -> None:
    """JSON lines under ``path``, a folder for each merchant."""
    rows.write.mode("overwrite").partitionBy("merchant").option("ignoreNullFields", False).json(path)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).json(path)
