"""Captured pages to scraped items: links of search pages, products of product pages.

Pages come as a table ``(merchant, query, kind, url, html)``; fetching them is no Spark work. HTML is
parsed in a pandas UDF that returns arrays; everything after is columns and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import features as X
from ..functions import markup
from ..functions.text import canonical_url, join_url, normalize_listing, price_plain, unescape_html
from ..plans.storage import materialize


@dataclass(frozen=True)
class Merchant:
    """How a shop's pages are read."""

    slug: str
    #: What the address of a product page contains, and must not.
    product_link: str
    not_link: str = "^$"
    #: Whether titles must share a word with the query, and items are unique by their id.
    relevance: bool = False
    #: Ids in addresses, for pages without one.
    id_in_url: str = r"-(\d+)$"
    #: What an id in the page looks like; it is written in capitals then.
    id_pattern: str | None = None
    #: Where the brand is missing, the title's first word.
    brand_from_title: bool = False
    gallery: bool = False


MERCHANTS = [
    Merchant("n11", r"n11\.com.*/urun/", gallery=True),
    Merchant("hepsiburada", r"^https?://(www\.)?hepsiburada\.com/.*(?i)-p[-/]", id_in_url=r"(?i)-p-([A-Z0-9]+)$", id_pattern=r"(?i)\b(HB(?:CV|V)?[A-Z0-9]+)\b", brand_from_title=True),
    Merchant("mediamarkt", r"mediamarkt\.com\.tr/tr/product/.*\.html$", relevance=True, id_in_url="^$", brand_from_title=True),
    Merchant("vatan", r"^https?://(www\.)?vatanbilgisayar\.com/.*(?i)\.html$", not_link=r"(?i)/(kategori|marka|arama)/", relevance=True, id_in_url="^$", brand_from_title=True),
]

#: Signs of a page that blocks readers, in lower case. Fixed values.
BLOCKED = ["just a moment", "are you a human", "captcha", "access denied", "güvenlik doğrulaması", "security check", "cloudflare"]

#: Marketplaces by domain, in order. Fixed values.
MARKETPLACES = {
    "trendyol.com": "Trendyol", "hepsiburada.com": "Hepsiburada", "amazon.com.tr": "Amazon", "n11.com": "n11", "pttavm.com": "PttAVM", "idefix.com": "idefix", "pazarama.com": "Pazarama",
    "mediamarkt.com.tr": "MediaMarkt", "vatanbilgisayar.com": "Vatan", "teknosa.com": "Teknosa",
}


def is_blocked(html: Column, title: Column) -> Column:
    """Whether the title or the first 12,000 characters hold a sign of blocking."""
    start = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(html, F.lit("")), 1, 12_000)))
    return start.rlike("|".join(BLOCKED))


def exploded_links(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, pos, href, url, title, text)``: anchors of each page, addresses resolved and canonical."""
    rows = pages.select(*keys, F.col("url").alias("page_url"), F.explode(markup.read_page("html")["links"]).alias("x"))
    rows = rows.withColumn("full", join_url("page_url", "x.href"))
    return rows.select(*keys, "x.pos", "x.href", canonical_url(F.col("full")).alias("url"), "x.title", "x.text")


def first_links(rows: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Each address once a page, at its first place; the first ``limit`` of them."""
    once = rows.groupBy(*keys, "url").agg(F.min("pos").alias("pos"))
    if limit is None:
        return once
    return once.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("nth") <= limit).drop("nth")


def product_links(pages: DataFrame, merchants: list[Merchant] = MERCHANTS, limit: int = DEFAULT.search_limit) -> DataFrame:
    """``(merchant, query, url, pos)``: product pages that search pages link to."""
    rows = exploded_links(pages.where("kind = 'search'"), ["merchant", "query"])
    fits = F.lit(False)
    for m in merchants:
        fits = fits | ((F.col("merchant") == m.slug) & F.col("url").rlike(m.product_link) & ~F.col("url").rlike(m.not_link))
    return first_links(rows.where(fits), ["merchant", "query"], limit)


def titled_links(pages: DataFrame, keys: list[str], product_link: str, limit: int = DEFAULT.search_limit, least: int = 3) -> DataFrame:
    """``(keys, url, pos, title)``: links whose address fits the pattern and whose title, spaces made single, has
    ``least`` characters or more; each address once, the first ``limit`` of a page."""
    rows = exploded_links(pages, keys).withColumn("title", F.trim(F.regexp_replace(F.coalesce(F.nullif("title", F.lit("")), "text"), r"\s+", " ")))
    rows = rows.where(F.col("url").rlike(product_link) & (F.length("title") >= least))
    once = rows.groupBy(*keys, "url").agg(F.min(F.struct("pos", "title")).alias("first")).select(*keys, "url", "first.*")
    return once.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("nth") <= limit).drop("nth")


def _json(column: str, path: str) -> Column:
    return F.get_json_object(column, path)


def _text_or_first(column: str, field: str, *inner: str) -> Column:
    """A text, or a field of an object, or of a list's first element."""
    value = F.coalesce(*[_json(column, f"$.{field}.{i}") for i in inner], *[_json(column, f"$.{field}[0].{i}") for i in inner], _json(column, f"$.{field}[0]"), _json(column, f"$.{field}"))
    value = F.trim(value)
    return F.when((value == "") | value.startswith("{") | value.startswith("["), None).otherwise(value)


def first_offer(product: str) -> Column:
    """The first offer with a price, else the first, as JSON."""
    offers = _json(product, "$.offers")
    listed = F.from_json(F.when(offers.startswith("["), offers).otherwise(F.concat(F.lit("["), offers, F.lit("]"))), "array<string>")
    priced = F.filter(listed, lambda o: F.get_json_object(o, "$.price").isNotNull() | F.get_json_object(o, "$.lowPrice").isNotNull())
    return F.coalesce(F.get(priced, 0), F.get(listed, 0))


def gtin_of(product: str) -> Column:
    """The first of the GTIN fields with a run of 8, 12, 13 or 14 digits; the check digit is not looked at."""
    tries = [F.regexp_extract(F.coalesce(_json(product, f"$.{k}"), F.lit("")), r"(?<!\d)(\d{8,14})(?!\d)", 1) for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin")]
    return F.coalesce(*[F.when(F.length(t).isin(8, 12, 13, 14), t) for t in tries])


def title_matches_query(title_tokens: Column, query_tokens: Column) -> Column:
    """Any word of three letters or more of the query is in the title; true if the query has none."""
    asked = F.filter(query_tokens, lambda t: F.length(t) >= 3)
    return (F.size(asked) == 0) | F.arrays_overlap(title_tokens, asked)


def gallery_image(pages: DataFrame) -> DataFrame:
    """``(merchant, query, url, image)`` of pages with their ``images``: the one whose text fits the title best, if it scores
    3 or more; the first wins ties."""
    keys = ["merchant", "query", "url"]
    rows = pages.select(*keys, normalize_listing(F.col("title")).alias("t"), F.explode("images").alias("x")).withColumn("alt", normalize_listing(F.col("x.alt")))
    rows = rows.where(F.col("x.url").rlike(r"n11scdn|akamaized\.net"))
    score = (
        F.when(F.col("alt") == "", 0).otherwise(F.size(F.array_intersect(F.split("t", " "), F.split("alt", " "))) + F.when(F.contains("alt", "t"), 100).otherwise(0))
        + F.when(F.col("x.url").rlike("400_570|600_600|(?i)org"), 5).otherwise(0) + F.when(F.contains("x.url", F.lit("IMG-")), 3).otherwise(0)
    )
    return rows.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("x.pos")).alias("p"), F.col("x.url").alias("image"))).alias("b")).where("b.score >= 3").select(*keys, "b.image")


def parsed_items(pages: DataFrame, merchants: list[Merchant] = MERCHANTS, limit: int = DEFAULT.search_limit) -> DataFrame:
    """Scraped items of product pages (merchant, query, url, html, pos): title, price and id are required. A page is
    parsed once, and what was read of it is stored, without its HTML, before rows are sorted."""
    p = pages.where("kind = 'product'").select("merchant", "query", "url", "pos", markup.read_page("html").alias("page"))
    p = p.select("merchant", "query", "url", "pos", F.get("page.products", 0).alias("product"), "page.images").where("product is not null")
    p = materialize(p.withColumn("offer", first_offer("product")).withColumn("title", F.trim(F.coalesce(_json("product", "$.name"), F.lit("")))), "read-pages")
    known, from_title, relevance, gallery, url_id = F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.lit("")
    said = [F.trim(F.coalesce(_json("product", f"$.{k}"), F.lit(""))) for k in ("sku", "productID", "mpn")]
    for m in merchants:
        own = F.col("merchant") == m.slug
        known, from_title, relevance, gallery = known | own, from_title | (own & F.lit(m.brand_from_title)), relevance | (own & F.lit(m.relevance)), gallery | (own & F.lit(m.gallery))
        in_url = F.regexp_extract(canonical_url(F.col("url")), m.id_in_url, 1) if "(" in m.id_in_url else F.lit("")
        url_id = F.when(own, F.upper(in_url) if m.id_pattern else in_url).otherwise(url_id)
        if m.id_pattern:
            said = [F.when(own, F.upper(F.regexp_extract(x, m.id_pattern, 1))).otherwise(x) for x in said]
    ident = F.coalesce(*[F.nullif(x, F.lit("")) for x in said], F.nullif(url_id, F.lit("")))
    price = F.coalesce(*[F.when(price_plain(_json("offer", f"$.{k}")) != 0, price_plain(_json("offer", f"$.{k}"))) for k in ("price", "lowPrice")])
    brand = F.coalesce(_text_or_first("product", "brand", "name"), F.when(from_title, F.get(F.split("title", r"\s+"), 0)))
    p = p.where(known).withColumns({"merchant_product_id": ident, "price": price, "brand": brand, "relevance": relevance, "gallery": gallery})
    p = p.where("title <> '' and price is not null and merchant_product_id is not null")
    fits = title_matches_query(X.tokens(normalize_listing(F.col("title"))), X.tokens(normalize_listing(F.col("query"))))
    p = p.where(~F.col("relevance") | fits)
    first = Window.partitionBy("merchant", "query", F.when(F.col("relevance"), F.col("merchant_product_id")).otherwise(F.col("url"))).orderBy("pos", "url")
    p = p.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    p = p.withColumn("nth", F.row_number().over(Window.partitionBy("merchant", "query").orderBy("pos", "url"))).where(F.col("nth") <= limit)
    p = p.join(gallery_image(p.where("gallery")), ["merchant", "query", "url"], "left")
    return p.select(
        "merchant", "merchant_product_id", "brand", "title", "price", F.coalesce("image", _text_or_first("product", "image", "url", "contentUrl")).alias("image_url"), canonical_url(F.col("url")).alias("product_url"),
        (~F.lower(F.coalesce(_json("offer", "$.availability"), F.lit(""))).contains("outofstock")).alias("in_stock"), gtin_of("product").alias("gtin"),
    )


def page_products(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, pos, product)``: every product object of a page as JSON, parents before what they hold."""
    return pages.select(*keys, F.posexplode(markup.read_page("html")["products"]).alias("pos", "product"))


def marketplace_of(url: Column, known: dict[str, str] = MARKETPLACES) -> Column:
    """The first marketplace whose domain the address contains, else Other."""
    out = F.lit("Other")
    for domain, name in reversed(known.items()):
        out = F.when(F.contains(url, F.lit(domain)), name).otherwise(out)
    return out


def comparison_offers(pages: DataFrame, keys: list[str], own_domain: str) -> DataFrame:
    """``(keys, place, price, seller, marketplace, url)``: offers that a comparison page holds as JSON-LD text,
    cheapest first. Only prices above 0 and addresses of other sites; each address once, whatever its query."""
    # fixed value: how the page writes an offer
    pattern = r'"@type":"Offer","availability":"[^"]*","price":"([0-9.]+)","url":"([^"]+)","seller":\{"@type":"Organization","name":"([^"]+)"'
    rows = pages.withColumn("_t", unescape_html("html")).select(*keys, F.posexplode(F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).alias("pos", "o"))
    part = lambda k: F.regexp_extract("o", pattern, k)
    rows = rows.select(*keys, "pos", part(1).try_cast("double").alias("price"), part(2).alias("url"), F.element_at(F.split(part(3), "/"), -1).alias("seller"))
    rows = rows.where((F.col("price") > 0) & F.col("url").startswith("http") & ~F.contains("url", F.lit(own_domain)))
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, F.get(F.split("url", r"\?"), 0)).orderBy("pos"))).where("n = 1")
    return once.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("price", "pos")).alias("place"), "price", "seller", marketplace_of(F.col("url")).alias("marketplace"), "url")


def comparison_products(pages: DataFrame, keys: list[str], base: str) -> DataFrame:
    """``(keys, pos, name, price, brand, vendor, image, url, code)``: products in a comparison page's embedded
    state, each address (or name, without one) once. Name and price are required."""
    # fixed values: how the page's state writes a product and its parts
    block = r'\[0,\{"code":\[0,\d+\].*?\}\]'
    rows = pages.withColumn("_t", unescape_html("html")).select(*keys, F.posexplode(F.regexp_extract_all("_t", F.lit(block), F.lit(0))).alias("pos", "b"))
    text = lambda key, shape=r'"([^"]+)"': F.nullif(F.regexp_extract("b", rf'"{key}":\[0,{shape}\]', 1), F.lit(""))
    url = text("url")
    rows = rows.select(
        *keys, "pos", text("name", r'"([^"]{5,200})"').alias("name"), text("price", r"([0-9.]+)").try_cast("double").alias("price"), text("mkName").alias("brand"), text("vdName").alias("vendor"),
        text("imageUrl").alias("image"), F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url).alias("url"), text("code", r"(\d+)").alias("code"),
    )
    rows = rows.where("name is not null and price is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, F.coalesce("url", "name")).orderBy("pos"))).where("n = 1").drop("n")


def title_confirms(page_title: Column, name: Column) -> Column:
    """Whether two or more of the name's first eight words of four letters are in the page's title; so an
    item list isn't taken for a product page."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9çğıöşü]{4,}"), F.lit(0))
    words = F.slice(F.filter(words, lambda t: ~t.isin("urun", "fiyat", "model")), 1, 8)
    return F.size(F.filter(words, lambda t: F.contains(F.lower(F.coalesce(page_title, F.lit(""))), t))) >= 2


def confirmed_products(pages: DataFrame, candidates: int = 40, enough: int = 5) -> DataFrame:
    """``(merchant, query, place, url, name, price)``: of a search's first ``candidates`` product pages, the first
    ``enough`` that hold a product with a price and a name that the page's title confirms."""
    own = Window.partitionBy("merchant", "query").orderBy("pos", "url")
    # addresses are ranked without their pages, and only pages that may count are read
    some = pages.where("kind = 'product'")
    first = some.select("merchant", "query", "pos", "url").withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= candidates).drop("nth").distinct()
    p = some.join(first, ["merchant", "query", "pos", "url"], "left_semi")
    p = p.withColumn("product", F.get(markup.read_page("html")["products"], 0)).where("product is not null").withColumn("offer", first_offer("product"))
    price = F.coalesce(*[F.when(price_plain(_json("offer", f"$.{k}")) != 0, price_plain(_json("offer", f"$.{k}"))) for k in ("price", "lowPrice")])
    p = p.select("merchant", "query", "pos", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), _json("product", "$.name").alias("name"), price.alias("price"))
    p = p.where(F.col("price").isNotNull() & title_confirms(F.col("title"), F.col("name")))
    return p.withColumn("place", F.row_number().over(own)).where(F.col("place") <= enough).select("merchant", "query", "place", "url", "name", "price")


def search_url(query: Column, routes: dict[str, str], base: str) -> Column:
    """Where to search: the first word of the query that has a category page of its own, else the search page."""
    words = F.split(normalize_listing(query), " ")
    table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair]) if routes else None
    found = F.get(F.filter(F.transform(words, lambda w: table[w]), lambda u: u.isNotNull()), 0) if routes else F.lit(None)
    return F.coalesce(found, F.concat(F.lit(base), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20"))))
