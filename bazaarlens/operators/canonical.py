"""Canonical products of accepted groups: which value survives, and in what order groups are applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import brand_key, clean_title, normalize_matching
from ..plans.linkage import first_disjoint
from ..plans.storage import materialize

NO_TITLE = "Eşleştirilmiş ürün"


def applied_groups(groups: DataFrame, facts: DataFrame, rows: DataFrame, prior: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``(group_id)`` that are applied: good enough, no product matched before (in any state), and no product
    taken by a better group of this run, in order of score, size and slot."""
    good = facts.where(F.col("best_score") >= settings.auto_approve)
    products = groups.join(good.select("group_id", "best_score", "size", "slot"), ["group_id", "slot"]).join(rows.select("offer_id", "product_id"), "offer_id")
    products = products.select("group_id", "best_score", "size", "slot", "product_id").distinct()
    taken = products.join(prior.select("product_id"), "product_id", "left_semi").select("group_id").distinct()
    free = materialize(products.join(taken, "group_id", "left_anti"), "free-groups")
    claims = free.select(F.col("group_id").alias("name"), F.col("product_id").alias("key"), "best_score", "size", "slot")
    order = [-F.col("best_score"), -F.col("size"), F.col("slot"), F.col("name")]
    return first_disjoint(claims, order).withColumnRenamed("name", "group_id")


def survivors(members: DataFrame) -> DataFrame:
    """One row for each group of (group_id, offer_id, title, brand, valid_gtin, volume, colours).

    Title: the shortest cleaned one, then the first of the alphabet. Brand: the most frequent key, then
    the longest spelling, then the first one; as first spelled. GTIN and capacity: the value if there is
    just one. Colour: the first that all members with colours share. All are aggregates; brands are
    counted by key first.
    """
    m = members.withColumn("clean", F.nullif(clean_title(F.col("title")), F.lit(""))).withColumn("trimmed", F.trim("brand"))
    m = m.withColumn("key", F.nullif(brand_key(F.col("trimmed")), F.lit("")))
    counted = m.where("key is not null").groupBy("group_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("offer_id", "trimmed")).alias("first"))
    brand = counted.groupBy("group_id").agg(F.min(F.struct(-F.col("n"), -F.length("first.trimmed"), F.col("first.offer_id"), F.col("first.trimmed").alias("brand"))).alias("b")).select("group_id", "b.brand")
    single = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    facts = m.groupBy("group_id").agg(
        F.coalesce(F.min_by("clean", F.struct(F.length("clean"), F.lower("clean"), "offer_id")), F.lit(NO_TITLE)).alias("title"), single("valid_gtin").alias("gtin"), single("volume").alias("capacity_ml"),
        F.count_if(F.size("colours") > 0).alias("coloured"),
    )
    shades = m.select("group_id", F.explode("colours").alias("colour")).groupBy("group_id", "colour").agg(F.count(F.lit(1)).alias("n"))
    shades = shades.join(facts.select("group_id", "coloured"), "group_id").where("n = coloured").groupBy("group_id").agg(F.min("colour").alias("color"))
    return facts.join(brand, "group_id", "left").join(shades, "group_id", "left").select("group_id", "brand", "title", normalize_matching(F.col("title")).alias("normalized_title"), "capacity_ml", "color", "gtin")


def canonical_rows(survived: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return survived.select(
        F.concat(F.lit("canonical-"), "group_id").alias("id"), "brand", "title", "normalized_title", "capacity_ml", "color", "gtin", F.lit(True).alias("active"), F.lit(settings.as_of).alias("updated_at")
    )


def match_rows(applied: DataFrame, groups: DataFrame, facts: DataFrame, rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One approved row for each member of an applied group."""
    members = groups.join(applied, "group_id").join(facts.select("group_id", "best_score", "reasons"), "group_id").join(rows.select("offer_id", "product_id"), "offer_id")
    return members.select(
        F.concat(F.lit("match-"), "offer_id").alias("id"), F.concat(F.lit("canonical-"), "group_id").alias("canonical_product_id"), "product_id", F.bround("best_score", 2).alias("match_score"),
        F.col("reasons").alias("match_reason"), F.lit("approved").alias("status"), F.lit(settings.as_of).alias("updated_at"),
    )
