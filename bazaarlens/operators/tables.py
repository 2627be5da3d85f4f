"""Writes as sets: upsert, patch, get-or-create, append, and one batch of scraped items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import normalize_matching


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the columns that ``new`` has overwritten where keys are equal, and new keys added;
    columns that ``new`` lacks stay, or are null in added rows. Keys of ``new`` are unique."""
    given = [c for c in new.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in given], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, keys, "full_outer")
    return both.select(*[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns])


def upsert_newer(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """``upsert`` of the rows of ``new`` that are not older than the row they replace."""
    known = old.select(*keys, F.col(time).alias("_known"))
    return upsert(old, new.join(known, keys, "left").where(F.col("_known").isNull() | (F.col(time) >= F.col("_known"))).drop("_known"), keys)


def patch(table: DataFrame, where, values: dict) -> DataFrame:
    """``table`` with columns set in the rows that ``where`` selects."""
    return table.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def get_or_create(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``wanted`` whose key it lacks."""
    missing = wanted.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.unionByName(missing, allowMissingColumns=True)


def ingest(items: DataFrame, merchants: DataFrame, products: DataFrame, variants: DataFrame, offers: DataFrame, history: DataFrame, settings: Settings = DEFAULT, refresh_images: tuple[str, ...] = ("n11",)) -> dict[str, DataFrame]:
    """All tables after a batch of scraped items, as one merge.

    Items without an id, title or price are left out; of items with one key the last address counts.
    Known offers get price, address, image, currency, stock and times; others get product (by slug),
    variant (by sku) and offer. Every item adds a snapshot. Images of known variants, and of their
    products, are renewed for the merchants of ``refresh_images`` only.

    Items are shuffled once by merchant and number of the product, which picks their last address and finds known
    offers, and once by sku. Offers don't read the new products and variants: a new variant's id follows from its sku.
    """
    now = F.lit(settings.as_of)
    good = items.where("merchant_product_id <> '' AND title <> '' AND price IS NOT NULL")
    shops = get_or_create(merchants, good.select(F.col("merchant").alias("slug")).distinct().select(F.concat(F.lit("m-"), "slug").alias("id"), F.initcap("slug").alias("name"), "slug", F.lit(True).alias("active")), "slug")
    old_shops = merchants.select(F.col("id").alias("_shop_id"), F.col("slug").alias("merchant"), F.lit(True).alias("_shop"))
    keyed = good.where("merchant IS NOT NULL").join(old_shops, "merchant", "left")
    keyed = keyed.withColumn("merchant_id", F.when(F.col("_shop"), F.col("_shop_id")).otherwise(F.concat(F.lit("m-"), "merchant"))).drop("_shop", "_shop_id")
    # so dealt out, both the first of each key and the join with known offers find their rows
    keyed = keyed.repartition("merchant_id", "merchant_product_id")
    keyed = first_per_key(keyed, ["merchant_id", "merchant_product_id", "merchant"], [F.desc("product_url"), F.desc("price"), F.desc("title")])
    keyed = keyed.withColumn("sku", F.concat_ws(":", "merchant", "merchant_product_id")).withColumn("slug", F.concat_ws("-", "merchant", "merchant_product_id"))
    known = offers.select(F.col("id").alias("offer_id"), "product_variant_id", "merchant_id", "merchant_product_id")
    keyed = keyed.join(known, ["merchant_id", "merchant_product_id"], "left")
    fresh = keyed.where("offer_id IS NULL")
    made = fresh.join(products.select("slug", F.col("id").alias("pid")), "slug", "left")
    made = made.select("slug", F.coalesce("pid", F.concat(F.lit("p-"), "slug")).alias("id"), "brand", "title", normalize_matching(F.col("title")).alias("normalized_title"), "image_url", F.lit(True).alias("active"))
    products_ = upsert(products, first_per_key(made, ["slug"], ["id"]), ["slug"])
    product_of = products_.select("slug", F.col("id").alias("product_id"))
    made = fresh.join(product_of, "slug").select(F.concat(F.lit("v-"), "sku").alias("id"), "product_id", "gtin", "sku", "image_url", F.lit(True).alias("active"))
    variants_ = get_or_create(variants, made, "sku")
    new_images = keyed.where(F.col("offer_id").isNotNull() & F.col("image_url").isNotNull() & F.col("merchant").isin(*refresh_images)).select(F.col("product_variant_id").alias("id"), F.col("image_url").alias("_image"))
    variants_ = variants_.join(first_per_key(new_images, ["id"], ["_image"]), "id", "left").withColumn("image_url", F.coalesce("_image", "image_url")).select(*variants.columns)
    # the product of a renewed variant is renewed too; of several variants' images the last one counts
    of_products = new_images.join(variants.select("id", "product_id"), "id").select(F.col("product_id").alias("id"), "_image")
    products_ = products_.join(first_per_key(of_products, ["id"], [F.desc("_image")]), "id", "left").withColumn("image_url", F.coalesce("_image", "image_url")).select(*products.columns)
    old_variants = variants.select("sku", F.col("id").alias("_variant_id"), F.lit(True).alias("_variant"))
    vid = F.when(F.col("_variant"), F.col("_variant_id")).when(F.col("offer_id").isNull(), F.concat(F.lit("v-"), "sku"))
    rows = keyed.join(old_variants, "sku", "left").select(
        F.coalesce("offer_id", F.concat(F.lit("o-"), "sku")).alias("id"), F.coalesce("product_variant_id", vid).alias("product_variant_id"), "merchant_id", "merchant_product_id", "product_url", "price",
        F.lit("TRY").alias("currency"), F.coalesce("in_stock", F.lit(True)).alias("in_stock"), "image_url", now.alias("last_checked_at"), F.when(F.col("offer_id").isNotNull(), now).alias("updated_at"),
    )
    snapshot = rows.select(F.col("id").alias("offer_id"), "price", "in_stock", now.alias("checked_at"))
    return {"merchants": shops, "products": products_, "variants": variants_, "offers": upsert(offers, rows, ["id"]), "price_history": history.unionByName(snapshot)}
