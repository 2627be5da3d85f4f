"""Queries of the page operators, of ingestion and of deals with a history, each with SQL for the same rows.

Pages are written by Spark from parts, one form or another by the part's number, so that SQL can say from the
parts what an operator must find in the HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import text as T
from .operators import canonical, deals, pages, tables
from .queries import _OFFERS, _OUTCOMES, _deal_inputs, _history_sql, query
from .sources import adapters as A


def _case(by: int, forms: dict[int, Column], default: Column | None = None) -> Column:
    """One of several forms by the part's number modulo ``by``."""
    out = F.lit(None).cast("string") if default is None else default
    for rest, form in forms.items():
        out = F.when(F.col("k") % by == rest, form).otherwise(out)
    return out


def _say(template: str, **values: Column) -> Column:
    """A text with {names} replaced by columns."""
    out = F.lit(template)
    for name, value in {"k": F.col("k").cast("string"), **values}.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def product_pages(spark, d) -> DataFrame:
    """A product page of one of four shops for each part."""
    p = A.spread(A.table(spark, d, "part"), "p_partkey").withColumn("k", F.col("p_partkey")).withColumn("title", F.concat_ws(" ", "p_name", F.col("k").cast("string")))
    money, comma = F.format_string("%.2f", "p_retailprice"), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(","))
    price = _case(3, {0: _say('"{m}"', m=money), 1: _say("{m}", m=money), 2: _say('"{m} TL"', m=comma)})
    state = F.when(F.col("k") % 11 == 0, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock")
    offers = F.when(F.col("k") % 7 == 0, F.lit('"offers":{"availability":"https://schema.org/InStock"}')).otherwise(
        _case(2, {0: _say('"offers":[{"availability":"https://schema.org/OutOfStock"},{"price":{p},"availability":"{s}"}]', p=price, s=state), 1: _say('"offers":{"lowPrice":{p},"availability":"{s}"}', p=price, s=state)})
    )
    sku = F.when(F.col("k") % 4 == 1, _say('"sku":"hbcv{k}x"')).otherwise(_say('"sku":"S{k}"'))
    parts = [
        F.lit('"@type":["Thing","Product"]'), _say('"name":" {t} "', t=F.col("title")), _case(3, {0: _say('"brand":{"@type":"Brand","name":"{b}"}', b=F.col("p_brand")), 1: _say('"brand":"{b}"', b=F.col("p_brand"))}),
        _case(5, {0: sku, 1: sku, 2: sku, 3: _say('"productID":"P{k}"')}), _case(10, {9: _say('"mpn":"M{k}"')}),
        _case(6, {0: F.concat(F.lit('"gtin13":"869'), F.lpad(F.col("k").cast("string"), 10, "0"), F.lit('"')), 1: F.concat(F.lit('"gtin":"EAN 40'), F.lpad(F.col("k").cast("string"), 6, "0"), F.lit('."')), 2: F.concat(F.lit('"gtin8":"123456789","gtin":"0'), F.lpad(F.col("k").cast("string"), 11, "0"), F.lit('"'))}),
        _case(3, {0: _say('"image":["https://img.example/{k}.jpg","https://img.example/more.jpg"]'), 1: _say('"image":{"url":"https://img.example/{k}.jpg"}')}), offers,
    ]
    data = F.concat(F.lit('{"@context":"https://schema.org","@graph":[{"@type":"BreadcrumbList","name":"no product"},{'), F.concat_ws(",", *parts), F.lit("}]}"))
    picture = _case(8, {0: _say('<img src="https://n11scdn.akamaized.net/a1/400_570/IMG-{k}.jpg" alt="{t}"><img src="https://n11scdn.akamaized.net/a1/other.jpg" alt="more">', t=F.col("title"))}, F.lit(""))
    html = F.concat(F.lit('<html><script type="application/ld+json">{not json</script><script type="application/ld+json">'), data, F.lit("</script>"), picture, F.lit("</html>"))
    url = _case(4, {0: _say("https://www.n11.com/urun/part-{k}?ref=list"), 1: _say("https://www.hepsiburada.com/part-p-HB{k}A"), 2: _say("https://www.mediamarkt.com.tr/tr/product/_part-{k}.html#top"), 3: _say("https://www.vatanbilgisayar.com/part-{k}.html")})
    shop = _case(4, {0: F.lit("n11"), 1: F.lit("hepsiburada"), 2: F.lit("mediamarkt"), 3: F.lit("vatan")})
    asked = F.when(F.col("k") % 13 == 0, _say("zzz{k}")).otherwise(F.col("title"))
    return p.select(shop.alias("merchant"), asked.alias("query"), F.lit("product").alias("kind"), url.alias("url"), html.alias("html"), F.lit(0).alias("pos"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_retailprice, p_name || ' ' || p_partkey AS title FROM part),
x AS (SELECT *, CASE k % 4 WHEN 0 THEN 'n11' WHEN 1 THEN 'hepsiburada' WHEN 2 THEN 'mediamarkt' ELSE 'vatan' END AS merchant,
  CASE WHEN k % 5 < 3 THEN CASE WHEN k % 4 = 1 THEN 'HBCV' || k || 'X' ELSE 'S' || k END
       WHEN k % 5 = 3 AND k % 4 <> 1 THEN 'P' || k WHEN k % 10 = 9 AND k % 4 <> 1 THEN 'M' || k
       WHEN k % 4 = 0 THEN '' || k WHEN k % 4 = 1 THEN 'HB' || k || 'A' END AS merchant_product_id FROM p)
SELECT merchant, merchant_product_id, CASE WHEN k % 3 < 2 THEN p_brand WHEN k % 4 > 0 THEN split_part(p_name, ' ', 1) END AS brand, title, p_retailprice AS price,
  CASE WHEN k % 8 = 0 THEN 'https://n11scdn.akamaized.net/a1/400_570/IMG-' || k || '.jpg' WHEN k % 3 < 2 THEN 'https://img.example/' || k || '.jpg' END AS image_url,
  CASE k % 4 WHEN 0 THEN 'https://www.n11.com/urun/part-' || k WHEN 1 THEN 'https://www.hepsiburada.com/part-p-HB' || k || 'A' WHEN 2 THEN 'https://www.mediamarkt.com.tr/tr/product/_part-' || k || '.html' ELSE 'https://www.vatanbilgisayar.com/part-' || k || '.html' END AS product_url,
  k % 11 <> 0 AS in_stock, CASE k % 6 WHEN 0 THEN '869' || lpad('' || k, 10, '0') WHEN 1 THEN '40' || lpad('' || k, 6, '0') WHEN 2 THEN '0' || lpad('' || k, 11, '0') END AS gtin
FROM x WHERE k % 7 <> 0 AND merchant_product_id IS NOT NULL AND (k % 13 <> 0 OR k % 4 < 2)""")
def product_items(spark, d):
    return pages.parsed_items(product_pages(spark, d))


@query("""SELECT k, CAST(pos AS INTEGER) AS pos, sku, name FROM (
  SELECT p_partkey AS k, 0 AS pos, 'A' || p_partkey AS sku, p_name || ' & co' AS name FROM part
  UNION ALL SELECT p_partkey, 1, 'R' || p_partkey, 'part of it' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END, 'B' || p_partkey, '<b>&amp;</b>' FROM part WHERE p_partkey % 5 <> 0)""")
def page_products(spark, d):
    """All products of pages that a careless shop writes: capitals, broken nesting, entities, products inside products,
    lists of types, scripts of other kinds and scripts that are no JSON."""
    p = A.spread(A.table(spark, d, "part"), "p_partkey").withColumn("k", F.col("p_partkey"))
    inner = F.when(F.col("k") % 3 == 0, _say('"isRelatedTo":[{"@type":"Product","sku":"R{k}","name":"part of it"}],')).otherwise("")
    first = _say("""<HTML><BODY><P>one<P><B>two</P></I><SCRIPT TYPE=' application/ld+json '>[{"@type":"Product",{r}"sku":"A{k}","name":"{n} & co"}]</SCRIPT>""", r=inner, n=F.col("p_name"))
    second = F.when(F.col("k") % 5 != 0, _say("""<script type="application/ld+json" async>{"@graph":[{"@type":"Thing"},{"x":{"@type":["Thing","Product"],"sku":"B{k}","name":"<b>&amp;</b>"}}]}</SCRIPT >""")).otherwise("<script type=application/ld+json>{'@type': 'Product'}</script>")
    html = F.concat(first, F.lit("<script>var x = {\"@type\":\"Product\"};</script></div></div>"), second, F.lit("<a href=x>&lt;end"))
    found = pages.page_products(p.select("k", html.alias("html")), ["k"])
    return found.select("k", "pos", F.get_json_object("product", "$.sku").alias("sku"), F.get_json_object("product", "$.name").alias("name"))


@query("""WITH p AS (SELECT p_brand, p_partkey AS k, 'S' || p_partkey % 30 AS sku FROM part),
once AS (SELECT *, row_number() OVER (PARTITION BY p_brand, sku ORDER BY k) AS nth FROM p)
SELECT p_brand AS query, sku AS merchant_product_id, 'https://www.mediamarkt.com.tr/tr/product/_' || k || '.html' AS product_url FROM once WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY k) <= 20""")
def repeated_skus(spark, d):
    """Product pages of a search that repeat skus: the first page of each counts, and twenty items of a search."""
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    html = _say('<script type="application/ld+json">{"@type":"Product","name":"any {b}","sku":"S{r}","offers":{"price":5}}</script>', b=F.col("p_brand"), r=(F.col("k") % 30).cast("string"))
    shop = p.select(F.lit("mediamarkt").alias("merchant"), F.col("p_brand").alias("query"), F.lit("product").alias("kind"), _say("https://www.mediamarkt.com.tr/tr/product/_{k}.html").alias("url"), html.alias("html"), F.col("k").alias("pos"))
    return pages.parsed_items(shop).select(F.regexp_replace("title", "^any ", "").alias("query"), "merchant_product_id", "product_url")


def search_pages(spark, d) -> DataFrame:
    """A search page for each brand, with links to its parts: relative and absolute ones, other sites, other pages, and again."""
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    link = _case(4, {0: _say('<li><a href="/urun/part-{k}?ref=x" title="t">one</a>'), 1: _say('<a class=c href="https://www.n11.com/urun/part-{k};s=1">two</a>'), 2: _say('<a href="https://other.example/urun/part-{k}">no</a>'), 3: _say("<a href='/kategori/{k}'>no</a>")})
    again = _case(8, {0: _say('<a href="/urun/part-{k}#again">again</a>')}, F.lit(""))
    of = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("k", link.alias("link"), again.alias("again")))).alias("l"))
    html = F.concat(F.lit("<html><a name=top>no address</a>"), F.array_join(F.transform("l", lambda x: x["link"]), "\n"), F.array_join(F.transform("l", lambda x: x["again"]), ""), F.lit("</html>"))
    return of.select(F.lit("n11").alias("merchant"), F.col("p_brand").alias("query"), F.lit("search").alias("kind"), F.lit("https://www.n11.com/arama?q=x").alias("url"), html.alias("html"))


@query("""WITH l AS (SELECT p_brand, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS nth FROM l WHERE k % 4 < 2)
SELECT 'n11' AS merchant, p_brand AS query, 'https://www.n11.com/urun/part-' || k AS url, CAST(pos AS BIGINT) AS pos FROM f WHERE nth <= 20""")
def product_links(spark, d):
    return pages.product_links(search_pages(spark, d)).select("merchant", "query", "url", F.col("pos").cast("long").alias("pos"))


def comparison_pages(spark, d) -> DataFrame:
    """A comparison page for each brand, with an offer for each part, as escaped JSON in an attribute."""
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    site = _case(4, {0: F.lit("https://www.trendyol.com/p/"), 1: F.lit("https://www.amazon.com.tr/dp/"), 2: F.lit("https://mine.example/p/"), 3: F.lit("https://unknown.example/p/")})
    price = F.when(F.col("k") % 9 == 0, "0").otherwise(F.format_string("%.2f", "p_retailprice"))
    offer = '{"@type":"Offer","availability":"InStock","price":"{p}","url":"{u}{k}{q}","seller":{"@type":"Organization","name":"Mall/Shop {k}"}}'
    one = _say(offer, p=price, u=site, q=F.lit("?a=1"))
    again = _case(8, {0: _say("," + offer, p=F.lit("1.00"), u=site, q=F.lit("?b=2"))}, F.lit(""))
    of = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("k", F.concat(one, again).alias("o")))).alias("l"))
    html = F.concat(F.lit("<div data-state='["), F.replace(F.array_join(F.transform("l", lambda x: x["o"]), ","), F.lit('"'), F.lit("&quot;")), F.lit("]'></div>"))
    return of.select("p_brand", html.alias("html"))


@query("""SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY price, k) AS place, price, seller, marketplace, url FROM (
  SELECT p_brand, p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 1.00 ELSE p_retailprice END AS price, 'Shop ' || p_partkey AS seller,
    CASE p_partkey % 4 WHEN 0 THEN 'Trendyol' WHEN 1 THEN 'Amazon' ELSE 'Other' END AS marketplace,
    CASE p_partkey % 4 WHEN 0 THEN 'https://www.trendyol.com/p/' WHEN 1 THEN 'https://www.amazon.com.tr/dp/' ELSE 'https://unknown.example/p/' END || p_partkey || CASE WHEN p_partkey % 9 = 0 THEN '?b=2' ELSE '?a=1' END AS url
  FROM part WHERE p_partkey % 4 <> 2 AND (p_partkey % 9 <> 0 OR p_partkey % 8 = 0))""")
def comparison_offers(spark, d):
    found = pages.comparison_offers(comparison_pages(spark, d), ["p_brand"], "mine.example")
    return found.withColumn("place", F.col("place").cast("long"))


# ---- ingestion ----------------------------------------------------------------------------------


def _ingested(spark, d) -> dict[str, DataFrame]:
    """A batch: every second (shop, part) that has an offer, and all parts of a shop that is new."""
    pairs = A.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("price"))
    s, k, none = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.lit(None)
    # grouped by the offers' keys, so that a join on them needs no other shuffle
    of = A.table(spark, d, "lineitem").groupBy(s.alias("merchant_id"), k.alias("merchant_product_id")).agg(F.min("l_extendedprice").alias("price"))
    known = of.select(
        F.concat_ws("-", F.lit("o"), "merchant_id", "merchant_product_id").alias("id"), F.concat(F.lit("v-"), "merchant_product_id").alias("product_variant_id"), "merchant_id", "merchant_product_id", F.lit("old").alias("product_url"), (F.col("price") + 1).alias("price"),
        F.lit("TRY").alias("currency"), F.lit(False).alias("in_stock"), none.cast("string").alias("image_url"), none.cast("timestamp").alias("last_checked_at"), none.cast("timestamp").alias("updated_at"),
    )
    renewed = pairs.where((F.col("l_suppkey") + F.col("l_partkey")) % 2 == 0).select(
        F.concat(F.lit("shop-"), s).alias("merchant"), k.alias("merchant_product_id"), F.lit("b").alias("brand"), F.lit("t").alias("title"), "price", F.lit("pic").alias("image_url"), F.lit("new").alias("product_url"), F.lit(None).cast("boolean").alias("in_stock"), F.lit(None).cast("string").alias("gtin"),
    )
    p = A.table(spark, d, "part")
    k, n = F.col("p_partkey").cast("string"), F.col("p_partkey")
    fresh = p.select(
        F.lit("fresh").alias("merchant"), F.when(n % 17 != 0, k).otherwise("").alias("merchant_product_id"), F.col("p_brand").alias("brand"), F.when(n % 10 != 0, F.upper("p_name")).alias("title"), F.when(n % 9 != 0, F.col("p_retailprice")).alias("price"),
        F.lit("pic").alias("image_url"), F.concat(F.lit("a/"), k).alias("product_url"), (n % 2 == 0).alias("in_stock"), F.lpad(k, 13, "0").alias("gtin"),
    )
    twice = fresh.where("price is not null").withColumns({"product_url": F.concat(F.lit("b/"), "merchant_product_id"), "price": F.col("price") + 5})
    items = renewed.unionByName(fresh).unionByName(twice)
    history = A.price_history(spark, d).select("offer_id", "price", "in_stock", "checked_at")
    return tables.ingest(items, A.merchants(spark, d), A.products(spark, d), A.variants(spark, d), known, history)


_FRESH = "(SELECT p_partkey AS k, p_brand, upper(p_name) AS title, p_name, p_retailprice + 5 AS price, p_partkey % 2 = 0 AS in_stock FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 9 <> 0)"
_PAIRS = "(SELECT l_suppkey AS s, l_partkey AS k, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT 'o-' || s || '-' || k AS id, 'v-' || k AS product_variant_id, CAST(s AS VARCHAR) AS merchant_id, CAST(k AS VARCHAR) AS merchant_product_id,
  CASE WHEN (s + k) % 2 = 0 THEN 'new' ELSE 'old' END AS product_url, CASE WHEN (s + k) % 2 = 0 THEN price ELSE price + 1 END AS price, 'TRY' AS currency, (s + k) % 2 = 0 AS in_stock,
  CASE WHEN (s + k) % 2 = 0 THEN 'pic' END AS image_url, CASE WHEN (s + k) % 2 = 0 THEN TIMESTAMP '2024-01-31' END AS last_checked_at, CASE WHEN (s + k) % 2 = 0 THEN TIMESTAMP '2024-01-31' END AS updated_at FROM {_PAIRS}
UNION ALL SELECT 'o-fresh:' || k, 'v-fresh:' || k, 'm-fresh', CAST(k AS VARCHAR), 'b/' || k, price, 'TRY', in_stock, 'pic', TIMESTAMP '2024-01-31', NULL FROM {_FRESH}""")
def ingest_offers(spark, d):
    return _ingested(spark, d)["offers"]


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, 'part-' || p_partkey AS slug, NULL AS image_url FROM part
UNION ALL SELECT 'p-fresh-' || k, p_brand, 'fresh-' || k, 'pic' FROM {_FRESH}""")
def ingest_products(spark, d):
    return _ingested(spark, d)["products"].select("id", "brand", "slug", "image_url")


@query(f"""SELECT 'v-' || p_partkey AS id, CAST(p_partkey AS VARCHAR) AS product_id, lpad(CAST(p_partkey * 7919 + 100000 AS VARCHAR), 13, '0') AS gtin, 'part:' || p_partkey AS sku, NULL AS image_url FROM part
UNION ALL SELECT 'v-fresh:' || k, 'p-fresh-' || k, lpad('' || k, 13, '0'), 'fresh:' || k, 'pic' FROM {_FRESH}""")
def ingest_variants(spark, d):
    return _ingested(spark, d)["variants"].select("id", "product_id", "gtin", "sku", "image_url")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS offer_id, value AS price, event_type <> 'error' AS in_stock, ts AS checked_at FROM events
UNION ALL SELECT 'o-' || s || '-' || k, price, true, TIMESTAMP '2024-01-31' FROM {_PAIRS} WHERE (s + k) % 2 = 0
UNION ALL SELECT 'o-fresh:' || k, price, in_stock, TIMESTAMP '2024-01-31' FROM {_FRESH}""")
def ingest_history(spark, d):
    return _ingested(spark, d)["price_history"]


@query("""SELECT kind, id, CASE WHEN k % 6 = 0 THEN 'new-' || k WHEN k % 5 = 0 THEN NULL ELSE 'old' END AS image_url
FROM (SELECT 'product' AS kind, '' || p_partkey AS id, p_partkey AS k FROM part UNION ALL SELECT 'variant', 'v-' || p_partkey, p_partkey FROM part)""")
def renewed_images(spark, d):
    """Images of products and variants after known offers came again: one shop of two renews them, where it has one."""
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    key = F.col("k").cast("string")
    shop = F.when(F.col("k") % 3 == 0, "n11").otherwise("vatan")
    none = F.lit(None).cast("string")
    merchants = A.merchants(spark, d).unionByName(spark.createDataFrame([(f"m-{s}", s, s, None, True) for s in ("n11", "vatan")], A.merchants(spark, d).schema))
    known = p.select(
        F.concat(F.lit("o-"), key).alias("id"), F.concat(F.lit("v-"), key).alias("product_variant_id"), F.concat(F.lit("m-"), shop).alias("merchant_id"), key.alias("merchant_product_id"), F.lit("u").alias("product_url"), F.col("p_retailprice").alias("price"),
        F.lit("TRY").alias("currency"), F.lit(True).alias("in_stock"), none.alias("image_url"), F.lit(None).cast("timestamp").alias("last_checked_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    items = p.select(
        shop.alias("merchant"), key.alias("merchant_product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("new-"), key)).alias("image_url"),
        F.lit("u").alias("product_url"), F.lit(True).alias("in_stock"), none.alias("gtin"),
    )
    old = F.when(F.col("k") % 5 != 0, F.lit("old"))
    of_product = A.products(spark, d).withColumn("k", F.col("id").cast("long")).withColumn("image_url", old).drop("k")
    of_variant = A.variants(spark, d).withColumn("k", F.col("product_id").cast("long")).withColumn("image_url", old).drop("k")
    out = tables.ingest(items, merchants, of_product, of_variant, known, A.price_history(spark, d).select("offer_id", "price", "in_stock", "checked_at"))
    return out["products"].select(F.lit("product").alias("kind"), "id", "image_url").unionByName(out["variants"].select(F.lit("variant").alias("kind"), "id", "image_url"))


# ---- deals with a history -------------------------------------------------------------------------

_SNAPSHOTS = f"""(SELECT o.id AS offer_id, price * (1 + l_tax) AS value, TIMESTAMP '2024-01-21' AS ts FROM {_OFFERS.replace("l_shipdate FROM", "l_shipdate, l_tax, l_linenumber FROM")} o
  UNION ALL SELECT o.id, price, TIMESTAMP '2024-01-30' FROM {_OFFERS} o
  UNION ALL SELECT o.id, price * 1.5, TIMESTAMP '2023-09-01' FROM {_OFFERS} o)"""
_CANDIDATES = f"(SELECT cheapest_offer_id AS offer_id, cheapest_price AS current_price FROM {_OUTCOMES} WHERE outcome = 'candidate')"
_ANALYSED = _history_sql(_CANDIDATES).replace("FROM events WHERE value > 0 AND", f"FROM {_SNAPSHOTS} WHERE value > 0 AND").replace("CAST(h.user_id AS VARCHAR) = c.offer_id", "h.offer_id = c.offer_id")


def offer_history(spark, d) -> DataFrame:
    """Snapshots of every offer: dearer by its tax ten days ago, as now yesterday, and a price too old to count."""
    of = A.offers(spark, d).select(F.col("id").alias("offer_id"), "price", "in_stock")
    i = A.table(spark, d, "lineitem")
    i = i.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("offer_id"), (F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("price"), F.lit(True).alias("in_stock"))
    at = lambda rows, text: rows.withColumn("checked_at", F.to_timestamp(F.lit(text)))
    return at(i, "2024-01-21").unionByName(at(of, "2024-01-30")).unionByName(at(of.withColumn("price", F.col("price") * 1.5), "2023-09-01"))


def _inputs(spark, d):
    canonical_, matches, variants, offers, _, existing = _deal_inputs(spark, d)
    return canonical_, matches, variants, offers, offer_history(spark, d), existing


@query(f"""SELECT o.canonical_product_id, 'candidate' AS status, history_status = 'price_drop' AS verified, CASE WHEN history_status = 'price_drop' THEN TIMESTAMP '2024-01-31' END AS verified_at,
  history_status, history_points FROM {_OUTCOMES} o JOIN {_ANALYSED} a ON a.offer_id = o.cheapest_offer_id WHERE o.outcome = 'candidate'""")
def verified_deals(spark, d):
    return deals.run_deals(*_inputs(spark, d))[0].where("status = 'candidate'").join(A.canonical_products(spark, d).where("active").select(F.col("id").alias("canonical_product_id")), "canonical_product_id").select("canonical_product_id", "status", "verified", "verified_at", "history_status", "history_points")


@query(f"""SELECT count(*) FILTER (WHERE outcome = 'candidate') AS candidates, count(*) FILTER (WHERE outcome = 'candidate' AND history_status = 'price_drop') AS verified,
  count(*) FILTER (WHERE outcome = 'normal') AS below_threshold, count(*) FILTER (WHERE outcome = 'insufficient') AS insufficient FROM {_OUTCOMES} o LEFT JOIN {_ANALYSED} a ON o.outcome = 'candidate' AND a.offer_id = o.cheapest_offer_id""")
def verified_counters(spark, d):
    _, outcomes, analysed = deals.run_deals(*_inputs(spark, d))
    return deals.counters(outcomes, analysed)


@query("""SELECT CAST(user_id AS VARCHAR) AS offer_id, ts AS checked_at, value AS price, count(*) OVER long AS history_points,
  CAST(sum(CAST(value AS DECIMAL(24,6))) OVER short AS DOUBLE) / count(*) OVER short AS history_avg_30d, min(value) OVER long AS history_low_90d,
  CASE WHEN value < CAST(sum(CAST(value AS DECIMAL(24,6))) OVER short AS DOUBLE) / count(*) OVER short
    THEN (CAST(sum(CAST(value AS DECIMAL(24,6))) OVER short AS DOUBLE) / count(*) OVER short - value) / (CAST(sum(CAST(value AS DECIMAL(24,6))) OVER short AS DOUBLE) / count(*) OVER short) * 100 ELSE 0 END AS mean_drop_percent
FROM events WHERE value > 0
WINDOW long AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW), short AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""")
def history_replay(spark, d):
    """What verification would have known at each snapshot of the whole history."""
    return deals.history_replay(A.price_history(spark, d))


@query(f"""WITH m AS (SELECT '' || p_partkey AS c, p_partkey AS product FROM part WHERE p_partkey % 30 <> 29
  UNION ALL SELECT '' || (p_partkey + 1), p_partkey FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT '' || (p_partkey // 2), p_partkey FROM part WHERE p_partkey % 11 = 0),
owner AS (SELECT product, max(c) AS c FROM m WHERE CAST(c AS BIGINT) % 20 <> 19 AND CAST(c AS BIGINT) IN (SELECT p_partkey FROM part) GROUP BY 1)
SELECT c AS canonical_product_id, count(*) AS offers, count(DISTINCT l_partkey) AS products, min(price) AS lowest FROM {_OFFERS} o JOIN owner ON product = l_partkey WHERE in_stock AND price > 0 AND l_partkey % 50 <> 49 GROUP BY 1""")
def shared_products(spark, d):
    """Offers of canonical products where a product belongs to up to three: the highest id that is active counts."""
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    none = F.lit(None).cast("timestamp")
    more = p.where("k % 7 = 0").select((F.col("k") + 1).cast("string").alias("c"), "k").unionByName(p.where("k % 11 = 0").select(F.floor(F.col("k") / 2).cast("string").alias("c"), "k"))
    more = more.select(F.concat_ws("-", F.lit("x"), "c", "k").alias("id"), F.col("c").alias("canonical_product_id"), F.col("k").cast("string").alias("product_id"), F.lit(90.0).alias("match_score"), F.lit("gtin").alias("match_reason"), F.lit("approved").alias("status"), none.alias("updated_at"))
    grouped = deals.offer_groups(A.canonical_products(spark, d), A.product_matches(spark, d).unionByName(more), A.variants(spark, d), A.offers(spark, d))
    of = grouped.withColumn("product", F.split("offer_id", "-")[2])
    return of.groupBy("canonical_product_id").agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("product").alias("products"), F.min("price").alias("lowest"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS offer_id, date_trunc('second', ts) AS checked_at FROM events WHERE event_id % 10 <> 0""")
def iso_history(spark, d):
    """Times as text, with Z or an offset; text that is no time leaves no snapshot."""
    second = F.date_trunc("second", "ts")
    text = F.when(F.col("event_id") % 10 == 0, F.lit("yesterday")).when(F.col("event_id") % 2 == 0, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(second + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+03:00'"))
    e = A.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("offer_id"), text.alias("checked_at"))
    return deals.typed_history(e)


# ---- texts and survivors --------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN floor(o_totalprice) WHEN 4 THEN NULL ELSE o_totalprice END AS any_price,
  CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN NULL WHEN 3 THEN floor(o_totalprice * 10) / 10 WHEN 4 THEN floor(o_totalprice) END AS in_lira,
  CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN o_totalprice END AS turkish FROM orders""")
def price_spellings(spark, d):
    """Amounts written in several ways, some with other numbers before them, some without any amount."""
    k, whole = F.col("o_orderkey"), F.floor("o_totalprice")
    points = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    plain, comma = F.format_string("%.2f", "o_totalprice"), F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    tenths = F.replace(F.format_string("%.1f", F.floor(F.col("o_totalprice") * 10) / 10), F.lit("."), F.lit(","))
    grouped = F.translate(F.format_number(whole, 0), ",", ".")
    pick = lambda n, *forms: F.element_at(F.array(*forms), (k % n + 1).cast("int"))
    any_ = pick(5, F.concat(F.lit("₺"), points), F.concat(comma, F.lit(" TL")), F.concat(F.lit("TL "), plain), F.concat(whole.cast("string"), F.lit(" lira")), F.lit("fiyat yok"))
    lira = pick(5, F.concat(F.lit("-20% eski 5 adet "), points, F.lit("TL")), F.concat(grouped, F.lit(" ₺ + 30 TL kargo")), F.concat(points, F.lit(" EUR")), F.concat(tenths, F.lit(" tl")), F.concat(whole.cast("string"), F.lit("₺")))
    turkish = pick(3, F.concat(grouped, F.lit(" TL")), points, F.lit("sorunuz"))
    return A.table(spark, d, "orders").select("o_orderkey", T.price_any(any_).alias("any_price"), T.price_currency(lira).alias("in_lira"), T.price_turkish(turkish).alias("turkish"))


@query("""WITH m AS (SELECT p_partkey % 100 AS g, p_partkey AS k, lpad('' || p_partkey, 12, '0') AS offer, p_brand, CASE WHEN p_partkey % 300 < 200 THEN 'W' || p_partkey % 100 END AS gtin, p_size FROM part),
brands AS (SELECT g, p_brand, count(*) AS n, min(offer) AS first FROM m GROUP BY 1, 2),
modes AS (SELECT g, arg_min(p_brand, (-n, -len(p_brand), first)) AS brand FROM brands GROUP BY 1),
shades AS (SELECT g, unnest(CASE WHEN k % 3 = 0 THEN [] WHEN g % 4 = 1 THEN ['c' || k % 7] WHEN g % 2 = 0 THEN ['c0', 'blue'] ELSE ['c1'] END) AS colour FROM m),
coloured AS (SELECT g, count(*) FILTER (WHERE k % 3 <> 0) AS n FROM m GROUP BY 1),
shared AS (SELECT g, min(colour) AS color FROM (SELECT s.g, colour FROM shades s JOIN coloured c USING (g) GROUP BY 1, 2, c.n HAVING count(*) = c.n) GROUP BY 1)
SELECT '' || m.g AS group_id, any_value(brand) AS brand, CASE WHEN min(gtin) = max(gtin) THEN min(gtin) END AS gtin, CASE WHEN min(p_size) = max(p_size) THEN min(p_size) END AS capacity_ml, any_value(color) AS color
FROM m JOIN modes USING (g) LEFT JOIN shared USING (g) GROUP BY m.g""")
def survivors_of_mixed_groups(spark, d):
    """Groups whose members differ in brand, colour, GTIN and volume."""
    p = A.table(spark, d, "part").withColumn("k", F.col("p_partkey")).withColumn("g", F.col("k") % 100)
    none = F.array().cast("array<string>")
    colours = F.when(F.col("k") % 3 == 0, none).when(F.col("g") % 4 == 1, F.array(F.concat(F.lit("c"), (F.col("k") % 7).cast("string")))).when(F.col("g") % 2 == 0, F.array(F.lit("c0"), F.lit("blue"))).otherwise(F.array(F.lit("c1")))
    members = p.select(F.col("g").cast("string").alias("group_id"), F.lpad(F.col("k").cast("string"), 12, "0").alias("offer_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.when(F.col("k") % 300 < 200, F.concat(F.lit("W"), F.col("g").cast("string"))).alias("valid_gtin"), F.col("p_size").alias("volume"), colours.alias("colours"))
    return canonical.survivors(members).select("group_id", "brand", "gtin", "capacity_ml", "color")
