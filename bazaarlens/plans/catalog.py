"""Category tree, runs and their summaries, and the whole price pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import canonical, deals, matching
from .storage import materialize

TREE = "version int, categories array<struct<name string, slug string, active boolean, subcategories array<struct<name string, slug string, active boolean, queries array<string>>>>>"


def read_tree(spark, path: str) -> DataFrame:
    return spark.read.schema(TREE).option("multiLine", True).json(path)


def active_subcategories(tree: DataFrame, slug: str | None = None, limit: int | None = None) -> DataFrame:
    """Active subcategories with a query: the first query, the others as aliases. A missing flag counts as
    active; blank queries are dropped; ``limit`` is 1 at least."""
    c = tree.select(F.posexplode("categories").alias("cpos", "c")).where(F.coalesce("c.active", F.lit(True)))
    s = c.select("cpos", "c.name", "c.slug", F.posexplode("c.subcategories").alias("spos", "s")).where(F.coalesce("s.active", F.lit(True)))
    asked = F.filter(F.transform("s.queries", lambda q: F.trim(q)), lambda q: q != "")
    rows = s.withColumn("q", asked).where("size(q) > 0").select(
        "cpos", "spos", F.col("name").alias("category"), F.col("slug").alias("category_slug"), F.col("s.name").alias("subcategory"), F.col("s.slug").alias("subcategory_slug"), F.get("q", 0).alias("query"),
        F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))).alias("aliases"),
    )
    rows = rows.where(F.col("subcategory_slug") == slug) if slug else rows
    rows = rows.orderBy("cpos", "spos")
    return (rows.limit(max(1, int(limit))) if limit is not None else rows).drop("cpos", "spos")


def collector_steps(subcategories: DataFrame, merchants: DataFrame) -> DataFrame:
    """A step for each subcategory and merchant; the merchants are a short stated list."""
    return subcategories.select("subcategory_slug", "query").join(F.broadcast(merchants.select("merchant")), F.lit(True))


def run_summary(steps: DataFrame) -> DataFrame:
    """Of (stage, name, ok, seconds, code): steps, those that went well and failed, and seconds, for each stage."""
    return steps.groupBy("stage").agg(F.count(F.lit(1)).alias("steps"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("seconds").alias("seconds"))


def offers_per_marketplace(offers: DataFrame) -> DataFrame:
    return offers.groupBy("marketplace").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lowest"), F.min_by("url", F.struct("price", "url")).alias("cheapest_url"))


def price_pipeline(t: dict[str, DataFrame], settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Match, canonicalise and detect deals over all tables; edges and groups are computed once."""
    rows = matching.offer_rows(t["merchants"], t["products"], t["product_variants"], t["offers"])
    found = matching.resolve(rows, settings)
    featured, groups, facts = found["featured"], found["groups"], found["facts"]
    applied = materialize(canonical.applied_groups(groups, facts, featured, t["product_matches"], settings), "applied")
    members = groups.join(applied, "group_id").join(featured, "offer_id")
    products = t["canonical_products"].unionByName(canonical.canonical_rows(canonical.survivors(members), settings))
    matches = t["product_matches"].unionByName(canonical.match_rows(applied, groups, facts, featured, settings))
    new, outcomes, analysed = deals.run_deals(products, matches, t["product_variants"], t["offers"], t["price_history"], t["deal_candidates"], settings)
    return {"canonical_products": products, "product_matches": matches, "deal_candidates": new, "groups": groups, "group_facts": facts, "outcomes": outcomes, "analysed": analysed, "feed": deals.deal_feed(new, products, t["offers"], t["merchants"], settings.feed_limit)}

