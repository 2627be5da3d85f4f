"""Cards of rendered search pages to items.

A browser that renders pages is no Spark work; what it sees of each card arrives as a row ``CARDS``: the
addresses in order of preference, texts, image addresses, and the nodes that look like prices with
their class names. All rules are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import canonical_url, join_url, price_currency

CARDS = (
    "merchant string, query string, page_url string, pos int, hrefs array<string>, brand_text string, title string, image_alt string, images array<string>, card_text string, "
    "nodes array<struct<text:string, meta:string, parent:string, leaf:boolean, visible:boolean>>"
)
#: Words of promotions, of current prices and of other prices. Fixed values.
PROMO = ["indirim", "kupon", "puan", "cashback", "kazanç", "kazanc", "trendyol plus"]
CURRENT = ["current", "selling", "discounted", "sale", "prc-box-dscntd", "prc-box-sllng"]
OTHER = ["old", "original", "list", "strike", "crossed", "campaign", "coupon", "benefit"]
#: What a node's signs count for being the current price. Fixed values.
POINTS = {"current": 100, "price": 35, "other": -140, "promo": -180, "promo around": -80, "leaf": 20, "one amount": 15}
#: Ids in addresses, by merchant, in order. Fixed values.
URL_IDS = {
    "trendyol": [r"-p-(\d+)(?:$|[/?#])"],
    "hepsiburada": [r"(?i)-p-([A-Z0-9]+)(?:$|[/?#])", r"(?i)/(HBCV[A-Z0-9]+)(?:$|[/?#])", r"(?i)/(HBC[A-Z0-9]+)(?:$|[/?#])", r"(?i)(HB[A-Z0-9]{6,})"],
}
MONEY = r"(?i)(?:\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?|\d+(?:,\d{1,2})?)\s*(?:TL|₺)"


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def node_score(node: Column) -> Column:
    """How much a node looks like the current price."""
    meta, own, parent = F.lower(F.coalesce(node["meta"], F.lit(""))), F.lower(F.coalesce(node["text"], F.lit(""))), F.lower(F.coalesce(node["parent"], F.lit("")))
    current = _any(meta, CURRENT)
    signs = {
        "current": current, "price": F.contains(meta, F.lit("price")), "other": _any(meta, OTHER), "promo": _any(own, PROMO), "promo around": _any(parent, PROMO) & ~current,
        "leaf": F.coalesce(node["leaf"], F.lit(False)), "one amount": F.regexp_count(node["text"], F.lit("(?i)TL|₺")) == 1,
    }
    total = F.lit(0)
    for name, sign in signs.items():
        total = total + F.when(sign, POINTS[name]).otherwise(0)
    return total


def text_price(text: Column) -> Column:
    """The first amount in a line without words of promotions."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"\r?\n")
    good = F.filter(lines, lambda x: ~_any(F.lower(x), PROMO) & x.rlike(MONEY))
    return price_currency(F.get(good, 0))


def current_price(nodes: Column, card_text: Column) -> Column:
    """The amount of the node that scores highest (of the first 20 by score, and 0 or more), the first of
    equals; else the text's."""
    shown = F.filter(nodes, lambda n: F.coalesce(n["visible"], F.lit(True)) & n["text"].rlike(MONEY))
    scored = F.transform(shown, lambda n, k: F.struct((-node_score(n)).alias("s"), k.alias("k"), n["text"].alias("t")))
    best = F.filter(F.slice(F.array_sort(scored), 1, 20), lambda n: n["s"] <= 0)
    return F.coalesce(price_currency(F.replace(F.get(F.transform(best, lambda n: n["t"]), 0), F.lit("\u00a0"), F.lit(" "))), text_price(card_text))


def card_brand(merchant: Column, brand_text: Column, title: Column, url: Column) -> Column:
    """The brand text without the title at its end; else, by merchant, the address's first part or the title's
    first word."""
    text = F.trim(F.coalesce(brand_text, F.lit("")))
    cut = F.when((F.coalesce(title, F.lit("")) != "") & F.endswith(text, title), F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(title)))).otherwise(text)
    part = F.initcap(F.replace(F.get(F.filter(F.split(F.parse_url(url, F.lit("PATH")), "/"), lambda p: p != ""), 0), F.lit("-"), F.lit(" ")))
    word = F.regexp_replace(F.get(F.split(F.trim(title), r"\s+"), 0), r"^[-–—|:]+|[-–—|:]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.nullif(F.when(merchant == "trendyol", part).otherwise(word), F.lit("")))


def id_in_url(merchant: Column, url: Column) -> Column:
    out = F.lit(None).cast("string")
    for slug, patterns in URL_IDS.items():
        out = F.when(merchant == slug, F.upper(F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns]))).otherwise(out)
    return out


def card_address(hrefs: Column) -> Column:
    """The first address that leads to a page."""
    return F.get(F.filter(hrefs, lambda h: (h != "") & ~h.startswith("javascript:")), 0)


def card_items(cards: DataFrame, limit: int = DEFAULT.search_limit, most_cards: int = 120) -> DataFrame:
    """Items of cards: the first ``most_cards`` of a page, each address once, the first ``limit`` of them. The
    price may be missing; a card without an address or title makes none."""
    c = cards.where(F.col("pos") < most_cards).withColumn("href", card_address(F.col("hrefs"))).where("href is not null")
    c = c.withColumn("product_url", canonical_url(join_url("page_url", "href"))).withColumn("name", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("image_alt"), F.lit("")))).where("name is not null")
    once = Window.partitionBy("merchant", "query", "product_url").orderBy("pos")
    c = c.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("merchant", "query").orderBy("pos"))).where(F.col("nth") <= limit)
    image = F.get(F.filter("images", lambda i: i.isNotNull() & (i != "")), 0)
    return c.select(
        "merchant", "query", id_in_url(F.col("merchant"), F.col("product_url")).alias("merchant_product_id"), card_brand(F.col("merchant"), F.col("brand_text"), F.col("name"), F.col("product_url")).alias("brand"), F.col("name").alias("title"),
        current_price(F.col("nodes"), F.col("card_text")).alias("price"), F.when(image.startswith("//"), F.concat(F.lit("https:"), image)).otherwise(image).alias("image_url"), "product_url", F.lit(True).alias("in_stock"), F.lit(None).cast("string").alias("gtin"),
    )


#: What addresses of product pages contain, by merchant, where cards are looked for around links. Fixed values.
PRODUCT_LINKS = {"hepsiburada": ["-p-HBC", "HBCV", "HBC000", "HB"]}


def link_card_items(cards: DataFrame, limit: int = DEFAULT.search_limit, most_links: int = 150) -> DataFrame:
    """Items of cards that stand around links to product pages, for the merchants of PRODUCT_LINKS: of a page's
    first ``most_links`` such links, those whose card names an amount. ``cards`` has a row for each link."""
    href, fits = card_address(F.col("hrefs")), F.lit(False)
    for merchant, signs in PRODUCT_LINKS.items():
        fits = fits | ((F.col("merchant") == merchant) & _any(href, signs))
    nth = F.row_number().over(Window.partitionBy("merchant", "query").orderBy("pos")) - 1
    near = cards.where(fits).withColumn("pos", nth).where((F.col("pos") < most_links) & _any(F.coalesce("card_text", F.lit("")), ["TL", "₺"]))
    return card_items(near, limit, most_links)


def items_or_fallback(cards: DataFrame, links: DataFrame, limit: int = DEFAULT.search_limit, most_cards: int = 120) -> DataFrame:
    """Items of cards with their query; a search without any takes those of the cards around its links."""
    found = card_items(cards, limit, most_cards)
    return found.unionByName(link_card_items(links, limit).join(found.select("merchant", "query").distinct(), ["merchant", "query"], "left_anti"))


#: Labels of links that lead to a shop and name nobody. Fixed values.
CALLS = ["satıcıya git", "saticiya git", "siteye git", "ürüne git", "urune git"]
LISTED = "id long, base string, rows array<struct<text:string, links array<struct<href:string, title:string, text:string>>>>"


def listed_offers(listings: DataFrame, price, most: int = 25) -> DataFrame:
    """Of (id, base, rows) of a comparison page's offer list: ``(id, offers, current_lowest_price, offer_count)``.
    An offer has the price in its text, its first two differing labels as merchant and seller, and its
    first address; offers stand cheapest first."""
    r = listings.select("id", "base", F.posexplode(F.slice("rows", 1, most)).alias("pos", "row")).withColumn("text", F.trim(F.regexp_replace("row.text", r"\s+", " "))).withColumn("price", price(F.col("text")))
    links = F.slice("row.links", 1, 12)
    labels = F.filter(F.transform(links, lambda x: F.trim(F.coalesce(F.nullif(x["title"], F.lit("")), x["text"], F.lit("")))), lambda t: (F.length(t) >= 2) & ~_any(F.lower(t), CALLS))
    labels = F.array_distinct(labels)
    href = F.get(F.filter(F.transform(links, lambda x: x["href"]), lambda h: h.isNotNull() & (h != "")), 0)
    r = r.where("price is not null").select("id", F.struct("price", "pos", F.get(labels, 0).alias("merchant"), F.get(labels, 1).alias("seller_name"), join_url("base", href).alias("url"), F.substring("text", 1, 500).alias("raw_text")).alias("o"))
    held = r.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("offers"))
    return listings.select("id").join(held, "id", "left").select("id", "offers", F.get("offers", 0)["price"].alias("current_lowest_price"), F.when(F.col("offers").isNull(), 0).otherwise(F.size("offers")).alias("offer_count"))
