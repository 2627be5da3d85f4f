"""Cross-store gaps, price history and the life cycle of deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import truthy
from ..plans.storage import materialize
from ..sources.buckets import of_keys


def offer_groups(canonical: DataFrame, matches: DataFrame, variants: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers in stock with a price above 0, by the active canonical product they belong to.

    A product in several canonical products belongs to the one with the highest id.
    """
    approved = matches.where((F.col("status") == "approved") & F.col("product_id").isNotNull()).select("canonical_product_id", "product_id")
    live = canonical.where("active").select(F.col("id").alias("canonical_product_id"))
    owner = approved.join(live, "canonical_product_id", "left_semi").groupBy("product_id").agg(F.max("canonical_product_id").alias("canonical_product_id"))
    of_variant = variants.where("active").select(F.col("id").alias("product_variant_id"), "product_id").join(owner, "product_id").select("product_variant_id", "canonical_product_id")
    priced = offers.where("in_stock").where(F.coalesce("price", F.lit(0.0)) > 0)
    shown = [c for c in ("currency", "product_url") if c in offers.columns]
    return priced.join(of_variant, "product_variant_id").select("canonical_product_id", F.col("id").alias("offer_id"), "merchant_id", "price", *shown)


def best_offer_per_merchant(grouped: DataFrame) -> DataFrame:
    """The cheapest offer of each merchant for each canonical product; ties go to the smaller offer id.

    An aggregate, so it is combined before the shuffle and no group is sorted.
    """
    rest = [c for c in grouped.columns if c not in ("canonical_product_id", "merchant_id", "price", "offer_id")]
    best = grouped.groupBy("canonical_product_id", "merchant_id").agg(F.min(F.struct("price", "offer_id", *rest)).alias("b"))
    return best.select("canonical_product_id", "merchant_id", "b.*")


def percent_cheaper(cheapest: Column, competitor: Column) -> Column:
    return F.when(competitor > 0, (competitor - cheapest) / competitor * 100).otherwise(0.0)


def price_drop_percent(current: Column, reference: Column) -> Column:
    return F.when((reference > 0) & (current < reference), (reference - current) / reference * 100).otherwise(0.0)


def ranked_gaps(grouped: DataFrame) -> DataFrame:
    """For each canonical product its number of merchants and the two cheapest offers of different
    merchants, with the gap between them; null where there is one merchant only."""
    best = best_offer_per_merchant(grouped.select("canonical_product_id", "merchant_id", "offer_id", "price"))
    counts = best.groupBy("canonical_product_id").agg(F.count(F.lit(1)).alias("n_merchants"))
    # the two smallest by (price, offer): the cheapest, and the cheapest of the others; the filter right above the rank
    # lets each task drop all but two of a product before the shuffle
    order = Window.partitionBy("canonical_product_id").orderBy("price", "offer_id")
    two = best.select("canonical_product_id", "offer_id", "merchant_id", "price").withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2)
    place = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    names = {1: "cheapest", 2: "competitor"}
    pair = two.groupBy("canonical_product_id").agg(*[place(n, f"{c}").alias(f"{who}_{c}") for n, who in names.items() for c in ("offer_id", "merchant_id", "price")])
    pair = counts.join(pair, "canonical_product_id")
    return pair.withColumn("gap_percent", F.when(F.col("n_merchants") > 1, percent_cheaper(F.col("cheapest_price"), F.col("competitor_price"))))


def classify(gaps: DataFrame, canonical: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``gaps`` for every active canonical product, with ``outcome``: insufficient, candidate or normal."""
    live = canonical.where("active").select(F.col("id").alias("canonical_product_id"))
    outcome = F.when(F.coalesce("n_merchants", F.lit(0)) < 2, "insufficient").when(F.col("gap_percent") + settings.slack >= settings.deal_threshold, "candidate").otherwise("normal")
    return live.join(gaps, "canonical_product_id", "left").withColumn("outcome", outcome)


def recent_history(history: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Snapshots with a price above 0 in the trailing window; the bound is a literal, so it is pushed down."""
    since = F.lit(settings.as_of) - F.expr(f"INTERVAL {settings.history_days} DAYS")
    return history.where((F.col("price") > 0) & (F.col("checked_at") >= since)).select("offer_id", "price", "checked_at")


def typed_history(history: DataFrame) -> DataFrame:
    """Snapshots whose ``checked_at`` is ISO text (with Z or an offset) as timestamps; text that is no time is left out."""
    return history.withColumn("checked_at", F.col("checked_at").try_cast("timestamp")).where("checked_at is not null")


def history_analysis(current: DataFrame, history: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """For each (offer_id, current_price): points, 30-day mean, 90-day low, last distinct price, strongest
    drop and the status that verifies a deal. Values are not rounded.

    One pass of aggregates over the joined snapshots. The mean is a sum of decimals over a count, so it
    doesn't depend on the order of rows.
    """
    since = F.lit(settings.as_of) - F.expr(f"INTERVAL {settings.average_days} DAYS")
    joined = current.select("offer_id", "current_price").join(recent_history(history, settings), "offer_id", "left")
    late, other = F.col("checked_at") >= since, F.abs(F.col("price") - F.col("current_price")) > settings.distinct_price
    exact = F.col("price").cast("decimal(24,6)")
    facts = joined.groupBy("offer_id", "current_price").agg(
        F.count("price").cast("int").alias("history_points"),
        (F.sum(F.when(late, exact)).cast("double") / F.count(F.when(late, 1))).alias("history_avg_30d"),
        F.min("price").alias("history_low_90d"),
        F.max_by("price", F.when(other, F.struct("checked_at", "price"))).alias("previous_distinct_price"),
    )
    drop = F.greatest(price_drop_percent(F.col("current_price"), F.col("previous_distinct_price")), price_drop_percent(F.col("current_price"), F.col("history_avg_30d")))
    facts = facts.withColumn("history_drop_percent", drop)
    status = (
        F.when(F.col("history_points") < 2, "insufficient_history").when(F.col("history_drop_percent") + settings.slack >= settings.history_drop_threshold, "price_drop")
        .when(F.col("previous_distinct_price").isNull(), "no_observed_drop").otherwise("no_significant_drop")
    )
    return facts.withColumn("history_status", status).withColumn("verified", F.col("history_status") == "price_drop")


def history_replay(history: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What a run at the time of each snapshot would have known: ``(offer_id, checked_at, price, history_points,
    history_avg_30d, history_low_90d, mean_drop_percent)``, by frames of time that end with the snapshot.

    Snapshots without a price above 0 are left out; those of one time see each other.
    """
    frame = lambda what, days: F.expr(f"{what} OVER (PARTITION BY offer_id ORDER BY checked_at RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND CURRENT ROW)")
    long, short = settings.history_days, settings.average_days
    rows = history.where(F.col("price") > 0).select("offer_id", "checked_at", "price")
    mean = frame("sum(cast(price AS decimal(24,6)))", short).cast("double") / frame("count(1)", short)
    rows = rows.select("*", frame("count(1)", long).alias("history_points"), mean.alias("history_avg_30d"), frame("min(price)", long).alias("history_low_90d"))
    return rows.withColumn("mean_drop_percent", price_drop_percent(F.col("price"), F.col("history_avg_30d")))


def two_decimals(x: Column) -> Column:
    """A number of 0 or more with two decimals, by its exact binary value, halves to the even digit, as C and Python print
    it; ``format_string`` rounds the shortest decimal text of the number, so that 1.005, which is less than that, becomes 1.01.

    The fraction is cut in two parts whose hundredfolds are exact. From 2**43 on a double has fewer bits than a cent needs.
    """
    whole = F.floor(x)
    fraction = x - whole
    upper = F.floor(fraction * 2.0**26) / 2.0**26
    cents = F.floor(upper * 100)
    missing = 0.5 - (upper * 100 - cents)  # from the upper part to the middle between two cents
    rest = (fraction - upper) * 100
    cents = whole * 100 + cents + F.when((rest > missing) | ((rest == missing) & (cents % 2 == 1)), 1).otherwise(0)
    exact = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when((x >= 0) & (x < 2.0**43), exact).otherwise(F.format_string("%.2f", x))


def history_label(status: Column, drop: Column, points: Column) -> Column:
    """What a report says of a status."""
    return (
        F.when(status == "price_drop", F.concat(F.lit("DOĞRULANDI (%"), two_decimals(drop), F.lit(" geçmiş fiyat düşüşü)")))
        .when(status == "insufficient_history", F.format_string("YETERSİZ VERİ (%d geçmiş kayıt)", points))
        .when(status == "no_observed_drop", F.lit("FİYAT DÜŞÜŞÜ HENÜZ GÖRÜLMEDİ"))
        .otherwise(F.concat(F.lit("ANLAMLI DÜŞÜŞ YOK (%"), two_decimals(drop), F.lit(")")))
    )


_GAP = ["cheapest_offer_id", "cheapest_merchant_id", "competitor_offer_id", "competitor_merchant_id"]
_MONEY = ["cheapest_price", "competitor_price", "gap_percent"]
_HISTORY = ["history_status", "history_points", "history_avg_30d", "history_low_90d", "previous_distinct_price", "history_drop_percent"]
_ROUNDED = {"history_avg_30d", "history_low_90d", "previous_distinct_price", "history_drop_percent"}


def next_deals(existing: DataFrame, outcomes: DataFrame, analysed: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The deal table after a run, as one outer join.

    A candidate is inserted or updated whole and keeps when it was first detected. Below the threshold a
    known deal expires with prices renewed and history left as it was. With fewer than two merchants a
    candidate expires and nothing else changes. Deals whose product is not active are not touched.
    """
    new = outcomes.join(analysed.withColumnRenamed("offer_id", "cheapest_offer_id").drop("current_price"), "cheapest_offer_id", "left")
    new = new.select("canonical_product_id", F.col("outcome"), *[F.col(c).alias(f"n_{c}") for c in (*_GAP, *_MONEY, *_HISTORY, "verified")])
    both = existing.join(new, "canonical_product_id", "full_outer")
    known, outcome, now = F.col("id").isNotNull(), F.col("outcome"), F.lit(settings.as_of)
    candidate, normal = outcome == "candidate", (outcome == "normal") & known
    expires = normal | ((outcome == "insufficient") & (F.col("status") == "candidate"))
    touched = candidate | expires
    shown = lambda c: F.bround(F.col(f"n_{c}"), 2) if c in _MONEY or c in _ROUNDED else F.col(f"n_{c}")
    keep = lambda when, value, c: F.when(when, value).otherwise(F.col(c)).alias(c)
    out = both.select(
        F.coalesce("id", F.concat(F.lit("deal-"), F.col("canonical_product_id"))).alias("id"), "canonical_product_id",
        *[keep(candidate | normal, shown(c), c) for c in (*_GAP[:2], "cheapest_price", *_GAP[2:], "competitor_price", "gap_percent")],
        keep(candidate | normal, F.lit(settings.deal_threshold), "threshold_percent"),
        F.when(candidate, "candidate").when(expires, "expired").otherwise(F.col("status")).alias("status"),
        keep(candidate & ~known, now, "detected_at"), keep(touched, now, "updated_at"),
        F.when(candidate, F.col("n_verified")).when(expires, False).otherwise(F.col("verified")).alias("verified"),
        F.when(candidate, F.when(F.col("n_verified"), now)).when(expires, None).otherwise(F.col("verified_at")).alias("verified_at"),
        *[keep(candidate, shown(c), c) for c in _HISTORY],
        keep(candidate, F.lit(settings.history_drop_threshold), "history_threshold_percent"), F.col("outcome").alias("_outcome"),
    )
    return out.where(known_or_new(out)).drop("_outcome")


def known_or_new(rows: DataFrame) -> Column:
    """A product that is no candidate and has no deal yet makes no row."""
    return rows["status"].isNotNull()


def counters(outcomes: DataFrame, analysed: DataFrame) -> DataFrame:
    """One row: candidates, verified ones, products under the threshold, products with too few merchants."""
    facts = outcomes.join(analysed.select(F.col("offer_id").alias("cheapest_offer_id"), "verified"), "cheapest_offer_id", "left")
    of = lambda x: F.count_if(F.col("outcome") == x)
    return facts.agg(of("candidate").alias("candidates"), F.count_if((F.col("outcome") == "candidate") & F.coalesce("verified", F.lit(False))).alias("verified"), of("normal").alias("below_threshold"), of("insufficient").alias("insufficient"))


def run_deals(canonical: DataFrame, matches: DataFrame, variants: DataFrame, offers: DataFrame, history: DataFrame, existing: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next deal table, outcomes, analysed candidates) of one run."""
    outcomes = classify(ranked_gaps(offer_groups(canonical, matches, variants, offers)), canonical, settings)
    current = outcomes.where("outcome = 'candidate'").select(F.col("cheapest_offer_id").alias("offer_id"), F.col("cheapest_price").alias("current_price"))
    analysed = history_analysis(current, history, settings)
    return next_deals(existing, outcomes, analysed, settings), outcomes, analysed


def deal_feed(deals: DataFrame, canonical: DataFrame, offers: DataFrame, merchants: DataFrame, limit: int = DEFAULT.feed_limit) -> DataFrame:
    """The candidates with the largest gaps, with names and links; missing or empty values have defaults. Rows of one
    offer id are one offer. Runs jobs: the ``limit`` deals are stored, and their offers are looked up by id, which reads
    few buckets of ``offers`` where these are in buckets by id."""
    top = materialize(deals.where("status = 'candidate'").orderBy(F.desc_nulls_first("gap_percent"), "canonical_product_id").limit(limit), "feed")
    shown = [r.id for r in top.select(F.col("cheapest_offer_id").alias("id")).distinct().collect()]  # ``limit`` ids at most
    offers = of_keys(offers.select("id", "product_url"), "id", shown).groupBy("id").agg(F.min("product_url").alias("product_url"))
    shop = merchants.select(F.col("id").alias("mid"), truthy(F.col("name"), F.col("slug"), F.lit("Mağaza")).alias("shop"))
    rows = (
        top.join(canonical.select(F.col("id").alias("canonical_product_id"), "title", "brand"), "canonical_product_id", "left")
        .join(offers.select(F.col("id").alias("cheapest_offer_id"), "product_url"), "cheapest_offer_id", "left")
        .join(shop.withColumnsRenamed({"mid": "cheapest_merchant_id", "shop": "merchant"}), "cheapest_merchant_id", "left")
        .join(shop.withColumnsRenamed({"mid": "competitor_merchant_id", "shop": "competitor_merchant"}), "competitor_merchant_id", "left")
    )
    return rows.select(
        "id", truthy(F.col("title"), F.lit("Ürün")).alias("title"), F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("cheapest_price", F.lit(0.0)).alias("price"),
        F.coalesce("competitor_price", F.lit(0.0)).alias("competitor_price"), F.coalesce("gap_percent", F.lit(0.0)).alias("gap_percent"), F.coalesce("history_drop_percent", F.lit(0.0)).alias("history_drop_percent"),
        F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("merchant", F.lit("Mağaza")).alias("merchant"), F.coalesce("competitor_merchant", F.lit("Rakip mağaza")).alias("competitor_merchant"),
        truthy(F.col("product_url"), F.lit("#")).alias("product_url"), F.coalesce(F.col("updated_at").cast("string"), F.lit("")).alias("updated_at"),
    )


def presented(feed: DataFrame) -> DataFrame:
    """Feed rows as shown: gap without decimals, drop text where there is one, amounts in lira."""
    lira = lambda c: F.concat(F.lit("₺"), F.translate(F.format_number(c, 2), ",.", ".,"))
    drop = F.when(F.col("history_drop_percent") > 0, F.format_string("%%%.1f", "history_drop_percent"))
    return feed.select("id", "title", "merchant", F.format_string("%%%.0f", "gap_percent").alias("gap"), drop.alias("drop"), lira("price").alias("price"), lira("competitor_price").alias("competitor_price"))


def feed_counters(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count(F.lit(1)).alias("deals"), F.count_if("verified").alias("verified"))
