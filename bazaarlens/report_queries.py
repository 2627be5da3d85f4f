"""Queries of cards, comparison pages, envelopes, group reports, approvals and the shown feed, each with SQL
for the same rows. What the operators read is written by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import features as X
from .functions import text as T
from .operators import canonical, cards, deals, matching, pages, selectors
from .page_queries import _ANALYSED, _case, _inputs, _say
from .plans import catalog
from .plans.storage import materialize, shared_dir
from .queries import _CURRENT, _FAMILIES, _OFFERS, _OUTCOMES, _TOKENS, SQL, _all_offers, _current, _history_sql, query
from .sources import adapters as A
from .sources import buckets
from .sources import envelopes as E
from .streaming import deals as stream_deals

# ---- cards ----------------------------------------------------------------------------------------


def _parts(spark, d) -> DataFrame:
    return A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))


def _lira(amount: str) -> Column:
    return F.concat(F.translate(F.format_number(amount, 2), ",.", ".,"), F.lit(" TL"))


def rendered_cards(spark, d) -> DataFrame:
    """A card for each part, 50 parts a search of two shops: prices in nodes or text, titles in images, repeated and dead addresses."""
    p = _parts(spark, d).withColumn("u", F.when((F.col("k") % 10).isin(8, 9), F.col("k") - 2).otherwise(F.col("k"))).withColumn("form", F.floor(F.col("k") / 2) % 4)
    shop = F.when(F.col("k") % 2 == 0, "trendyol").otherwise("hepsiburada")
    address = F.when(F.col("k") % 2 == 0, _say("/mark-{m}/item-p-{u}?a=1", m=(F.col("u") % 9).cast("string"), u=F.col("u").cast("string"))).otherwise(_say("/item-p-HB{u}?a=1", u=F.col("u").cast("string")))
    hrefs = F.when(F.col("k") % 11 == 0, F.array(F.lit("javascript:void(0)"))).when(F.col("k") % 5 == 0, F.array(F.lit(""), F.lit("javascript:go()"), address)).otherwise(F.array(address))
    node = lambda text, meta, visible=True: F.struct(text.alias("text"), F.lit(meta).alias("meta"), F.lit("").alias("parent"), F.lit(True).alias("leaf"), F.lit(visible).alias("visible"))
    money, old, other = _lira("p_retailprice"), F.lit("9.999,00 TL"), F.lit("12,50 TL")
    nodes = (
        F.when(F.col("form") == 1, F.array(node(old, "price old"), node(money, "prc-box-dscntd"))).when(F.col("form") == 2, F.array(node(money, "price current", False), node(other, "price")))
        .when(F.col("form") == 3, F.array(node(money, "price strike old"))).otherwise(F.array().cast("array<struct<text:string,meta:string,parent:string,leaf:boolean,visible:boolean>>"))
    )
    text = F.when(F.col("form") == 0, F.concat(F.lit("50 TL kupon\n"), money)).when(F.col("form") == 1, "yok").when(F.col("form") == 2, money).otherwise("sepette indirim 5 TL")
    search = F.concat(F.lit("q"), F.floor(F.col("k") / 50).cast("string"))
    place = (F.row_number().over(Window.partitionBy(shop, search).orderBy("k")) - 1).alias("pos")
    return p.select(
        shop.alias("merchant"), search.alias("query"), F.when(F.col("k") % 2 == 0, "https://www.trendyol.com/sr?q=x").otherwise("https://www.hepsiburada.com/ara?q=x").alias("page_url"), place, hrefs.alias("hrefs"),
        F.when(F.col("k") % 3 == 0, F.concat_ws(" ", "p_brand", "p_name")).alias("brand_text"), F.when(F.col("k") % 7 == 0, " ").otherwise(F.col("p_name")).alias("title"),
        F.when(F.col("k") % 21 != 0, F.col("p_name")).alias("image_alt"), F.array(F.lit(None).cast("string"), _say("//img.example/{k}.jpg")).alias("images"), text.alias("card_text"), nodes.alias("nodes"),
    )


def _items_sql(where: str) -> str:
    """Items of the cards that a condition leaves."""
    return f"""(SELECT * EXCLUDE (k, nth, once), row_number() OVER (PARTITION BY merchant, query ORDER BY k) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant, query, product_url ORDER BY k) AS once, 0 AS nth FROM (
  SELECT k, CASE WHEN k % 2 = 0 THEN 'trendyol' ELSE 'hepsiburada' END AS merchant, 'q' || k // 50 AS query, CASE WHEN k % 2 = 0 THEN '' || u ELSE 'HB' || u END AS merchant_product_id,
    CASE WHEN k % 3 = 0 THEN p_brand WHEN k % 2 = 0 THEN 'Mark ' || u % 9 ELSE split_part(p_name, ' ', 1) END AS brand, p_name AS title,
    CASE k // 2 % 4 WHEN 2 THEN 12.5 WHEN 3 THEN NULL ELSE p_retailprice END AS price, 'https://img.example/' || k || '.jpg' AS image_url,
    CASE WHEN k % 2 = 0 THEN 'https://www.trendyol.com/mark-' || u % 9 || '/item-p-' || u ELSE 'https://www.hepsiburada.com/item-p-HB' || u END AS product_url
  FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 IN (8, 9) THEN p_partkey - 2 ELSE p_partkey END AS u, p_name, p_brand, p_retailprice FROM part)
  WHERE k % 11 <> 0 AND k % 21 <> 0 AND {where})) WHERE once = 1 QUALIFY nth <= 20)"""


@query(f"SELECT * EXCLUDE (nth) FROM {_items_sql('true')}")
def card_items(spark, d):
    return cards.card_items(rendered_cards(spark, d)).drop("in_stock", "gtin")


@query(f"SELECT * EXCLUDE (nth) FROM {_items_sql('k // 50 % 3 <> 0')} UNION ALL SELECT * EXCLUDE (nth) FROM {_items_sql('k // 50 % 3 = 0 AND k % 2 = 1 AND k // 2 % 4 <> 1')}")
def card_fallback(spark, d):
    """Every third search shows no cards, so that the links of its page are used; only one of the shops has such links."""
    every = rendered_cards(spark, d)
    found = cards.items_or_fallback(every.where("cast(substring(query, 2) as int) % 3 <> 0"), every)
    return found.drop("in_stock", "gtin")


def card_pages(spark, d) -> DataFrame:
    """Search pages of two shops with 25 cards each, as HTML: empty first choices, titles and addresses in images only, prices
    beside old and hidden ones or in text only, links that lead nowhere."""
    p = _parts(spark, d).withColumn("money", _lira("p_retailprice"))
    k = F.col("k")
    shop = F.when(k % 2 == 0, "trendyol").otherwise("hepsiburada")
    dead = F.when(k % 5 == 0, F.lit("<a href='javascript:void(0)'>-p-</a>")).otherwise("")
    brand = F.when(k % 3 == 0, _say("<i class='Item item-brand'>{b}</i>", b=F.col("p_brand"))).otherwise("")
    image = F.when(k % 4 < 2, _say("<img src='//img.example/{k}.jpg' alt='{n}'>", n=F.col("p_name"))).otherwise(_say("<IMG SRC='' data-src='//img.example/{k}.jpg' ALT='{n}'/>", n=F.col("p_name")))
    even = _say("<a href='/mark-{m}/item-p-{k}?a=1'>{i}</a>", m=(k % 9).cast("string"), i=image)
    even_title = F.when(k % 6 == 0, F.lit("<span class='prdct-desc-cntnr-name'> </span>")).when(k % 6 == 2, _say("<span class='prdct-desc-cntnr-name'><!-- x --></span><b class='x product-name'>{n}</b>", n=F.col("p_name"))).otherwise(_say("<span class='a prdct-desc-cntnr-name'>{n}</span>", n=F.col("p_name")))
    even_price = F.when(k % 8 < 6, _say("<s class='price old'>9.999,00 TL</s><em class='price current' style='display: none'>1 TL</em><div class='prc-box-dscntd'>{p}</div>", p=F.col("money"))).otherwise(_say("<p>50 TL kupon</p>{p}", p=F.col("money")))
    odd = _say("<a href='/item-p-HBC{k}?a=1'>{i}</a>", i=image)
    odd_title = F.when(k % 6 == 1, _say("<h3>no</h3><h2 class='title-module_titleRoot-7'><span>{n}</span> more</h2>", n=F.col("p_name"))).when(k % 6 == 3, _say("<h2>no</h2><h3>{n}</h3>", n=F.col("p_name"))).otherwise("<h3> </h3>")
    odd_price = F.when(k % 4 == 1, _say("<div class='price-module_finalPrice'></div><p data-test-id='price-current-price'>indirim {p}</p>", p=F.col("money"))).otherwise(_say("<p>50 TL kupon<p>{p}", p=F.col("money")))
    card = F.when(k % 2 == 0, F.concat(F.lit("<div class='w p-card-wrppr'>"), dead, even, even_title, brand, even_price, F.lit("</div><div class='product-card'>no card</div>"))).otherwise(
        F.concat(F.lit("<li class='productListContent-x'>"), dead, odd, odd_title, brand, odd_price, F.lit("</p></li>"))
    )
    of = p.groupBy(shop.alias("merchant"), F.concat(F.lit("q"), F.floor(k / 50).cast("string")).alias("query")).agg(F.sort_array(F.collect_list(F.struct("k", card.alias("html")))).alias("l"))
    html = F.concat(F.lit("<!DOCTYPE html><HTML><head><title>12 TL</title></head><body><ul>"), F.array_join(F.transform("l", lambda x: x["html"]), "\n"), F.lit("</ul></body>"))
    return A.spread(of, "query").select("merchant", "query", F.format_string("https://www.%s.com/sr?q=x", "merchant").alias("page_url"), html.alias("html"))


@query("""SELECT * EXCLUDE (k) FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'trendyol' ELSE 'hepsiburada' END AS merchant, 'q' || p_partkey // 50 AS query,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'HBC' END || p_partkey AS merchant_product_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN 'Mark ' || p_partkey % 9 ELSE split_part(p_name, ' ', 1) END AS brand,
  p_name AS title, p_retailprice AS price, 'https://img.example/' || p_partkey || '.jpg' AS image_url,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://www.trendyol.com/mark-' || p_partkey % 9 || '/item-p-' ELSE 'https://www.hepsiburada.com/item-p-HBC' END || p_partkey AS product_url FROM part)
QUALIFY row_number() OVER (PARTITION BY merchant, query ORDER BY k) <= 20""")
def page_card_items(spark, d):
    return cards.card_items(selectors.page_cards(card_pages(spark, d))).drop("in_stock", "gtin")


@query(f"""SELECT merchant, query, n > 0 AS ok, n AS count, cheapest FROM (
  SELECT s.merchant, s.query, count(i.product_url) AS n, min(i.price) AS cheapest
  FROM (SELECT DISTINCT unnest(['trendyol', 'hepsiburada', 'n11']) AS merchant, 'q' || p_partkey // 50 AS query FROM part) s LEFT JOIN {_items_sql('true')} i ON i.merchant = s.merchant AND i.query = s.query GROUP BY 1, 2)""")
def search_envelopes(spark, d):
    """Envelopes of all searches, written as JSON and read back; one shop found nothing."""
    every = rendered_cards(spark, d)
    asked = every.select("query").distinct().withColumn("merchant", F.explode(F.array(F.lit("trendyol"), F.lit("hepsiburada"), F.lit("n11"))))
    path = f"{shared_dir(spark)}/envelopes-{uuid.uuid4().hex}"
    E.write_envelopes(E.envelopes(asked, cards.card_items(every)), path)
    back = E.read_envelopes(spark, path)
    return back.select("merchant", "query", "ok", "count", F.array_min(F.transform("products", lambda x: x["price"])).alias("cheapest"))


# ---- comparison pages -------------------------------------------------------------------------------


@query("""WITH r AS (SELECT p_partkey AS k, p_partkey // 30 AS id, p_retailprice AS price, row_number() OVER (PARTITION BY p_partkey // 30 ORDER BY p_partkey) AS nth FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY price, k) AS place, count(*) OVER (PARTITION BY id) AS offer_count, min(price) OVER (PARTITION BY id) AS lowest FROM r WHERE nth <= 25 AND k % 6 <> 0)
SELECT id, offer_count, lowest, place, price, CASE WHEN k % 4 <> 0 THEN 'Shop ' || k END AS merchant, CASE WHEN k % 4 = 1 THEN 'Seller ' || k END AS seller_name,
  CASE WHEN k % 4 = 0 THEN NULL ELSE 'https://c.example/go/' || k END AS url, CASE WHEN k % 10 = 0 THEN 500 ELSE len('Fiyat ' || price_text || ' TL') END AS text_length
FROM (SELECT *, printf('%,.2f', price) AS price_text FROM o)""")
def listed_offers(spark, d):
    """Offer lists of comparison pages, 30 parts each, of which 25 are read; some rows without a price or links, some very long."""
    p = _parts(spark, d)
    text = F.when(F.col("k") % 6 == 0, "sorunuz").otherwise(F.concat(F.lit(" Fiyat \n "), _lira("p_retailprice"), F.when(F.col("k") % 10 == 0, F.repeat(F.lit("  x"), 400)).otherwise("")))
    link = lambda href, title, label: F.struct(href.alias("href"), title.alias("title"), label.alias("text"))
    none = F.lit(None).cast("string")
    shop, seller, go = link(_say("/shop/{k}"), _say("Shop {k}"), F.lit("x")), link(_say("/seller/{k}"), F.lit(""), _say(" Seller {k}")), link(_say("/go/{k}"), none, F.lit("Satıcıya git"))
    links = F.when(F.col("k") % 4 == 0, F.array().cast("array<struct<href:string,title:string,text:string>>")).when(F.col("k") % 4 == 1, F.array(go, shop, shop, seller)).otherwise(F.array(go, shop))
    lists = p.groupBy(F.floor(F.col("k") / 30).alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", F.struct(text.alias("text"), links.alias("links")).alias("row")))).alias("l"))
    found = cards.listed_offers(lists.select("id", F.lit("https://c.example/").alias("base"), F.transform("l", lambda x: x["row"]).alias("rows")), T.price_turkish)
    rows = found.select("id", F.col("offer_count").cast("long").alias("offer_count"), F.col("current_lowest_price").alias("lowest"), F.posexplode("offers").alias("at", "o"))
    return rows.select("id", "offer_count", "lowest", (F.col("at") + 1).cast("long").alias("place"), "o.price", "o.merchant", "o.seller_name", "o.url", F.length("o.raw_text").cast("long").alias("text_length"))


@query("""SELECT p_brand, 'Item ' || p_partkey || ' ' || p_name AS name, p_retailprice AS price, p_brand AS brand, CASE WHEN p_partkey % 4 <> 0 THEN 'Vendor' END AS vendor,
  CASE p_partkey % 3 WHEN 0 THEN 'https://base.example/p/' || p_partkey WHEN 1 THEN 'https://other.example/' || p_partkey END AS url, '' || p_partkey AS code FROM part WHERE p_partkey % 6 <> 5""")
def comparison_products(spark, d):
    """Products in the embedded state of a comparison page for each brand, each twice, some without a price or an address."""
    p = _parts(spark, d)
    parts = [
        _say('"code":[0,{k}]'), _say('"name":[0,"Item {k} {n}"]', n=F.col("p_name")), F.when(F.col("k") % 6 != 5, _say('"price":[0,{p}]', p=F.format_string("%.2f", "p_retailprice"))), _say('"mkName":[0,"{b}"]', b=F.col("p_brand")),
        F.when(F.col("k") % 4 != 0, '"vdName":[0,"Vendor"]'), _case(3, {0: _say('"url":[0,"/p/{k}"]'), 1: _say('"url":[0,"https://other.example/{k}"]')}),
    ]
    block = F.concat(F.lit("[0,{"), F.concat_ws(",", *parts), F.lit("}]"))
    of = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("k", block.alias("b")))).alias("l"))
    state = F.array_join(F.transform("l", lambda x: x["b"]), ",")
    html = F.concat(F.lit("<astro-island props='"), F.replace(F.concat(state, F.lit(","), state), F.lit('"'), F.lit("&quot;")), F.lit("'></astro-island>"))
    return pages.comparison_products(of.select("p_brand", html.alias("html")), ["p_brand"], "https://base.example").select("p_brand", "name", "price", "brand", "vendor", "url", "code")


@query("""SELECT g, 'https://list.example/urun/' || k AS url, CAST(k - g * 40 AS INTEGER) AS pos, 'Item ' || p_name AS title FROM (
  SELECT p_partkey // 40 AS g, p_partkey AS k, p_name, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) AS nth FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 3 <> 2) WHERE nth <= 20""")
def titled_links(spark, d):
    """Lists of 40 links: some titles too short, some addresses of other kinds."""
    p = _parts(spark, d)
    path = F.when(F.col("k") % 3 == 2, "marka").otherwise("urun")
    title = F.when(F.col("k") % 5 == 4, "  ab ").otherwise(F.concat(F.lit(" Item  "), "p_name"))
    link = F.when(F.col("k") % 2 == 0, _say('<a href="/{p}/{k}?x" title="{t}">i</a>', p=path, t=title)).otherwise(_say('<a href="https://list.example/{p}/{k}"><b>{t}</b></a>', p=path, t=title))
    of = p.groupBy(F.floor(F.col("k") / 40).alias("g")).agg(F.sort_array(F.collect_list(F.struct("k", link.alias("l")))).alias("l"))
    html = F.array_join(F.transform("l", lambda x: x["l"]), "\n")
    return pages.titled_links(of.select("g", F.lit("https://list.example/").alias("url"), html.alias("html")), ["g"], "/urun/")


@query("""WITH p AS (SELECT p_partkey AS k, 'q' || p_partkey // 50 AS query, p_name, p_retailprice, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS nth FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k) AS place FROM p WHERE nth <= 40 AND k % 4 <> 1 AND k % 7 <> 0 AND k % 3 <> 2)
SELECT 'mediamarkt' AS merchant, query, place, 'https://m.example/' || k AS url, 'Widget' || k || ' Special' AS name, p_retailprice AS price FROM f WHERE place <= 5""")
def confirmed_products(spark, d):
    """Candidate pages of searches: lists that hold a product too, pages without a price or without product data."""
    p = _parts(spark, d)
    title = F.when(F.col("k") % 4 == 1, "All products of the urun fiyat model list").otherwise(_say("WIDGET{k} special - shop"))
    price = F.when(F.col("k") % 7 == 0, '{"priceCurrency":"TRY"}').otherwise(_say('[{"priceCurrency":"TRY"},{"lowPrice":"{p}"}]', p=F.format_string("%.2f", "p_retailprice")))
    data = F.when(F.col("k") % 3 == 2, '{"@type":"ItemList"}').otherwise(F.concat(_say('{"@type":"Product","name":"Widget{k} Special","offers":'), price, F.lit("}")))
    html = F.concat(F.lit("<html><head><title>"), title, F.lit('</title></head><script type="application/ld+json">'), data, F.lit("</script></html>"))
    found = pages.confirmed_products(p.select(F.lit("mediamarkt").alias("merchant"), F.concat(F.lit("q"), F.floor(F.col("k") / 50).cast("string")).alias("query"), F.lit("product").alias("kind"), _say("https://m.example/{k}").alias("url"), html.alias("html"), F.col("k").alias("pos")))
    return found.withColumn("place", F.col("place").cast("long"))


@query("""SELECT p_partkey AS k, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 'https://shop.example/c/red' WHEN split_part(p_name, ' ', 2) = 'bolt' THEN 'https://shop.example/c/bolt'
  ELSE 'https://shop.example/ara?q=' || upper(split_part(p_name, ' ', 1)) || '%20' || split_part(p_name, ' ', 2) END AS url FROM part""")
def search_routes(spark, d):
    asked = F.concat_ws(" ", F.upper(F.split("p_name", " ")[0]), F.split("p_name", " ")[1])
    return _parts(spark, d).select("k", pages.search_url(asked, {"bolt": "https://shop.example/c/bolt", "red": "https://shop.example/c/red"}, "https://shop.example/ara?q=").alias("url"))


# ---- texts and pairs --------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(trim(regexp_replace(strip_accents(low), '[^a-z0-9ı]+', ' ', 'g'))) AS listing, md5(trim(regexp_replace(low, '[^a-z0-9çğıöşü]+', ' ', 'g'))) AS card,
  md5(regexp_replace(replace(strip_accents(low), 'ı', 'i'), '[^a-z0-9]+', '', 'g')) AS brand FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS low FROM documents)""")
def folded_documents(spark, d):
    t = F.col("text")
    return A.table(spark, d, "documents").select("doc_id", F.md5(T.normalize_listing(t)).alias("listing"), F.md5(T.normalize_card(t)).alias("card"), F.md5(T.brand_key(t)).alias("brand"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'AB' || lpad('' || p_partkey % 10000, 4, '0') WHEN 1 THEN p_partkey % 90 + 10 || '-20-30' ELSE '' END AS models,
  CASE p_partkey % 4 WHEN 0 THEN 750 WHEN 1 THEN 1500 WHEN 2 THEN 355 ELSE 500 END AS volume_ml, CASE p_partkey % 4 WHEN 2 THEN 'black|red' ELSE '' END AS colours FROM part""")
def spelled_features(spark, d):
    """Model codes and volumes in several spellings, phrases of colours, codes that are too short."""
    title = F.coalesce(_case(4, {
        0: _say("Matara AB{n} .75", n=F.lpad((F.col("k") % 10000).cast("string"), 4, "0")), 1: _say("Bardak {n}-20-30 1,5 litre", n=(F.col("k") % 90 + 10).cast("string")), 2: F.lit("Mug KIRMIZI-SIYAH kirmizi siyah 12 oz"), 3: F.lit("Kupa x1 500 ml 2 lt"),
    }), F.lit(""))
    p = _parts(spark, d).withColumn("title", title).withColumn("tokens", X.tokens(T.normalize_matching(F.col("title"))))
    return p.select("k", F.array_join(X.model_codes(F.col("title")), "|").alias("models"), X.volume_ml(F.col("title"), F.col("tokens")).alias("volume_ml"), F.array_join(X.colours(F.col("tokens")), "|").alias("colours"))


_FEATURES = f"""(SELECT p_partkey AS k, p_brand, p_partkey % 6 AS merchant, CASE p_partkey % 8 WHEN 0 THEN '4006381333931' WHEN 1 THEN '12345670' END AS gtin,
  CASE WHEN p_size * 20 BETWEEN 10 AND 9999 THEN p_size * 20 END AS volume, coalesce((SELECT list(DISTINCT f) FROM (SELECT CASE t {_FAMILIES} END AS f FROM unnest({_TOKENS}) u(t)) WHERE f IS NOT NULL), []) AS colours FROM part)"""


@query(f"""SELECT a.o, a.k AS ka, b.k AS kb, CASE WHEN a.merchant = b.merchant THEN 'same-merchant' WHEN a.gtin = b.gtin THEN 'gtin' WHEN a.gtin IS NOT NULL AND b.gtin IS NOT NULL THEN 'gtin-conflict'
  WHEN a.p_brand <> b.p_brand THEN 'brand' WHEN abs(a.volume - b.volume) > 5 THEN 'volume-conflict' WHEN len(a.colours) > 0 AND len(b.colours) > 0 AND NOT list_has_any(a.colours, b.colours) THEN 'color-conflict' ELSE 'heuristic' END AS reason
FROM (SELECT l_orderkey AS o, l_linenumber AS n, f.* FROM lineitem JOIN {_FEATURES} f ON f.k = l_partkey) a JOIN (SELECT l_orderkey AS o, l_linenumber AS n, f.* FROM lineitem JOIN {_FEATURES} f ON f.k = l_partkey) b ON a.o = b.o AND a.n < b.n""")
def pair_reasons(spark, d):
    """Why parts bought together would or would not match, by the first reason that holds."""
    p = A.products(spark, d).withColumn("k", F.col("id").cast("long"))
    rows = p.select("k", "brand", "title", (F.col("k") % 6).cast("string").alias("merchant_id"), _case(8, {0: F.lit("4006381333931"), 1: F.lit("1234-5670")}).alias("gtin"))
    featured = matching.with_features(rows).select("k", F.struct("merchant_id", "valid_gtin", "brand_key", "volume", "colours", "models").alias("f"))
    of = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k")).join(featured, "k")
    a, b = of.select("o", F.col("n").alias("an"), F.col("k").alias("ka"), F.col("f").alias("x")), of.select("o", F.col("n").alias("bn"), F.col("k").alias("kb"), F.col("f").alias("y"))
    return a.join(b, "o").where("an < bn").select("o", "ka", "kb", F.coalesce(matching.conflict("x", "y"), F.lit("heuristic")).alias("reason"))


@query(f"""WITH g AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 100000 AS VARCHAR), 13, '0') AS s FROM part),
v AS (SELECT p_partkey FROM g WHERE (10 - list_sum(list_transform(range(1, 13), lambda k: CAST(s[k] AS INTEGER) * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(s[13] AS INTEGER)),
o AS (SELECT id, l_partkey, l_suppkey FROM {_OFFERS} JOIN v ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE in_stock)
SELECT a.id AS a, b.id AS b, 100.0::DOUBLE AS score FROM o a JOIN o b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey AND a.id < b.id""")
def gtin_edges(spark, d):
    """Edges of all offers, those by GTIN of them; the others' score is beyond SQL."""
    of, scored = matching.kind_edges(_all_offers(spark, d))
    return matching.offer_edges(of, scored.where("reason = 'gtin'")).select("a", "b", "score")


_VALID = """(SELECT p_partkey, (10 - list_sum(list_transform(range(1, 13), lambda k: CAST(s[k] AS INTEGER) * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(s[13] AS INTEGER) AS valid
  FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 100000 AS VARCHAR), 13, '0') AS s FROM part))"""
_STOCK = f"(SELECT id, l_partkey, l_suppkey, valid FROM {_OFFERS} JOIN {_VALID} ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE in_stock)"


@query(f"""SELECT a.id AS a, b.id AS b, CASE WHEN a.valid THEN 100.0 ELSE 88.0 END::DOUBLE AS score, CASE WHEN a.valid THEN 'gtin' ELSE 'heuristic' END AS reason
FROM {_STOCK} a JOIN {_STOCK} b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey AND a.id < b.id""")
def product_edges(spark, d):
    """Edges of all offers, those between offers of one product of them: titles are equal there, so that SQL knows the score."""
    edges = matching.offer_edges(*matching.kind_edges(_all_offers(spark, d)), part=F.split("offer_id", "-")[2])
    return edges.withColumn("score", F.round("score", 9))


@query(f"""WITH r AS (SELECT id, l_partkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY id) AS nth FROM {_STOCK} WHERE valid)
SELECT id AS offer_id, min(id) OVER (PARTITION BY l_partkey, nth) AS first_offer FROM r QUALIFY count(*) OVER (PARTITION BY l_partkey, nth) > 1""")
def gtin_groups(spark, d):
    """Groups of all offers, by the offers that share a product with a valid GTIN: such offers are merged before all
    others, the n-th of each merchant with the n-th of the others, and no later merge can join two of these sets."""
    found = matching.resolve(_all_offers(spark, d))
    part = found["featured"].where("valid_gtin is not null").select("offer_id", "product_id")
    own = Window.partitionBy("group_id", "product_id")
    rows = found["groups"].join(part, "offer_id").select("offer_id", F.min("offer_id").over(own).alias("first_offer"), F.count(F.lit(1)).over(own).alias("n"))
    return rows.where("n > 1").drop("n")


# ---- groups and approvals ---------------------------------------------------------------------------


@query(f"""WITH o AS (SELECT CAST(l_partkey AS VARCHAR) AS group_id, o.id, price, CASE WHEN l_suppkey % 10 <> 0 THEN s_name ELSE 'shop-' || l_suppkey END AS merchant, 80.0 + l_partkey % 20 AS best_score
  FROM {_OFFERS} o JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE in_stock),
top AS (SELECT group_id, any_value(best_score)::DOUBLE AS best_score, count(*) AS size, max(price) - min(price) AS spread, min(id) AS slot FROM o GROUP BY 1 ORDER BY best_score DESC, size DESC, slot LIMIT 30)
SELECT group_id, t.best_score, size, spread, row_number() OVER (PARTITION BY group_id ORDER BY price, merchant, id) AS place, row_number() OVER (PARTITION BY group_id ORDER BY price, merchant, id) = 1 AS cheapest, merchant, price FROM top t JOIN o USING (group_id)""")
def group_report(spark, d):
    """The report over groups of the offers of a product, with scores by its number."""
    rows = materialize(_all_offers(spark, d), "offers")
    groups = rows.select(F.col("product_id").alias("group_id"), "offer_id")
    facts = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min("offer_id").alias("slot")).withColumns({"best_score": 80.0 + F.col("group_id").cast("long") % 20, "reasons": F.lit("gtin")})
    report = matching.group_report(groups, facts, rows)
    return report.select("group_id", "best_score", "size", "spread", F.col("place").cast("long").alias("place"), "cheapest", "merchant", "price")


@query("""WITH o AS (SELECT p_partkey AS k, p_partkey // 5 AS g, p_size AS s FROM part),
e AS (SELECT a.g, 85 + (a.s * 3 + b.s) % 15 AS score, CASE (a.s + b.s) % 3 WHEN 0 THEN 'gtin' WHEN 1 THEN 'heuristic' ELSE 'model' END AS reason FROM o a JOIN o b ON a.g = b.g AND a.k < b.k WHERE a.s * b.s % 3 <> 0),
n AS (SELECT g, count(*) AS size FROM o GROUP BY 1)
SELECT '' || g AS group_id, any_value(size) AS size, CAST(max(score) AS DOUBLE) AS best_score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM e JOIN n USING (g) GROUP BY g""")
def group_facts(spark, d):
    """Best scores and joined reasons of groups of parts, by edges between sizes that depend on which one is first; a
    group without an edge has no facts."""
    p = _parts(spark, d).withColumn("group_id", F.floor(F.col("k") / 5).cast("string")).withColumn("offer_id", F.lpad(F.col("k").cast("string"), 12, "0"))
    groups = p.select("group_id", "offer_id", F.min("offer_id").over(Window.partitionBy("group_id")).alias("slot"))
    # a part's size is one of 50
    sizes = p.select(F.col("p_size").alias("ka")).distinct().withColumn("kb", F.explode(F.sequence(F.lit(1), F.lit(50)))).where("ka * kb % 3 <> 0")
    reason = F.element_at(F.array(F.lit("gtin"), F.lit("heuristic"), F.lit("model")), ((F.col("ka") + F.col("kb")) % 3 + 1).cast("int"))
    scored = sizes.select("ka", "kb", (85.0 + (F.col("ka") * 3 + F.col("kb")) % 15).alias("score"), reason.alias("reason"))
    return matching.group_facts(groups, p.select("offer_id", F.col("p_size").alias("kind")), scored).select("group_id", "size", "best_score", "reasons")


_GROUPS = "(SELECT p_partkey AS k, p_partkey // 2 AS g, CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 2 ELSE p_partkey END AS product FROM part)"


@query(f"""WITH m AS (SELECT * FROM {_GROUPS}), f AS (SELECT g, 85.126 + g * 7 % 13 AS score, count(*) AS size, min(k) AS slot FROM m GROUP BY 1),
free AS (SELECT * FROM f WHERE score >= 88 AND g NOT IN (SELECT g FROM m WHERE product % 30 = 29)),
applied AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY g // 2 ORDER BY score DESC, size DESC, slot) = 1)
SELECT 'match-' || k AS id, 'canonical-' || g AS canonical_product_id, '' || product AS product_id, round_even(score, 2)::DOUBLE AS match_score, 'gtin,heuristic' AS match_reason, 'approved' AS status FROM m JOIN applied USING (g)""")
def approved_matches(spark, d):
    """Match rows of the groups that apply: pairs of groups share a product, and rejected products were matched before."""
    p = _parts(spark, d)
    g = F.floor(F.col("k") / 2)
    rows = p.select(g.cast("string").alias("group_id"), F.col("k").cast("string").alias("offer_id"), F.when(F.col("k") % 4 == 3, F.col("k") - 2).otherwise(F.col("k")).cast("string").alias("product_id"), F.lpad((g * 2).cast("string"), 12, "0").alias("slot"))
    facts = rows.groupBy("group_id", "slot").agg(F.count(F.lit(1)).alias("size")).withColumns({"best_score": 85.126 + F.col("group_id").cast("long") * 7 % 13, "reasons": F.lit("gtin,heuristic")})
    groups, offers = rows.select("group_id", "slot", "offer_id"), rows.select("offer_id", "product_id")
    applied = canonical.applied_groups(groups, facts, offers, A.product_matches(spark, d).where("status = 'rejected'"))
    return canonical.match_rows(applied, groups, facts, offers).drop("updated_at")


@query("""SELECT p_partkey AS k, p_name AS title FROM part""")
def cleaned_titles(spark, d):
    """Titles with shops' endings, and dashes before them."""
    title = _case(3, {0: F.concat("p_name", F.lit(" - Fiyatları ve Özellikleri ")), 1: F.concat("p_name", F.lit(" FIYATLARI VE OZELLIKLERI")), 2: F.concat(F.lit("  "), "p_name")})
    return _parts(spark, d).select("k", T.clean_title(title).alias("title"))


@query("""SELECT n_name AS subcategory, r_name AS category, 'buy ' || lower(n_name) AS query FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 4 ORDER BY r_name, n_name LIMIT 7""")
def category_config(spark, d):
    """The category tree as a JSON file, read back; the first seven active subcategories, which is the feature."""
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    sub = F.struct(F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.when(F.col("n_nationkey") % 5 == 4, False).alias("active"), F.array(F.lit(""), F.concat(F.lit(" buy "), F.lower("n_name"))).alias("queries"))
    subs = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(sub), lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1)).alias("subcategories")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    category = F.struct(F.col("r_name").alias("name"), F.lower("r_name").alias("slug"), F.lit(True).alias("active"), "subcategories")
    tree = subs.agg(F.lit(1).alias("version"), F.array_sort(F.collect_list(category), lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1)).alias("categories"))
    path = f"{shared_dir(spark)}/categories-{uuid.uuid4().hex}"
    tree.coalesce(1).write.json(path)
    return catalog.active_subcategories(catalog.read_tree(spark, path), limit=7).select("subcategory", "category", "query")


# ---- the shown feed ---------------------------------------------------------------------------------


def _fed(spark, d) -> DataFrame:
    new = deals.run_deals(*_inputs(spark, d))[0]
    return deals.deal_feed(new, A.canonical_products(spark, d), A.offers(spark, d), A.merchants(spark, d))


_FED = f"""(SELECT o.*, h.history_drop_percent, history_status = 'price_drop' AS verified FROM (SELECT * FROM {_OUTCOMES} WHERE outcome = 'candidate' ORDER BY round_even(gap_percent, 2) DESC, canonical_product_id LIMIT 60) o
  JOIN {_ANALYSED} h ON h.offer_id = o.cheapest_offer_id)"""


def _shown(price: str) -> str:
    return f"'₺' || translate(printf('%,.2f', round_even({price}, 2)), ',.', '.,')"


@query(f"""SELECT 'deal-' || canonical_product_id AS id, CASE WHEN s_suppkey % 10 <> 0 THEN s_name ELSE 'shop-' || s_suppkey END AS merchant, '%' || CAST(floor(round_even(gap_percent, 2) + 0.5) AS INTEGER) AS gap,
  CASE WHEN round_even(history_drop_percent, 2) > 0 THEN '%' || CAST(round(CAST(round_even(history_drop_percent, 2) AS DECIMAL(12,2)), 1) AS DECIMAL(12,1)) END AS drop, {_shown("cheapest_price")} AS price, {_shown("competitor_price")} AS competitor_price
FROM {_FED} JOIN supplier ON s_suppkey = CAST(cheapest_merchant_id AS BIGINT)""")
def presented_feed(spark, d):
    return deals.presented(_fed(spark, d)).drop("title")


@query(f"SELECT count(*) AS deals, count(*) FILTER (WHERE verified) AS verified FROM {_FED}")
def feed_counters(spark, d):
    return deals.feed_counters(_fed(spark, d))


@query(f"""SELECT offer_id, CASE history_status WHEN 'price_drop' THEN 'DOĞRULANDI (%' || printf('%.2f', history_drop_percent) || ' geçmiş fiyat düşüşü)' WHEN 'insufficient_history' THEN 'YETERSİZ VERİ (' || history_points || ' geçmiş kayıt)'
  WHEN 'no_observed_drop' THEN 'FİYAT DÜŞÜŞÜ HENÜZ GÖRÜLMEDİ' ELSE 'ANLAMLI DÜŞÜŞ YOK (%' || printf('%.2f', history_drop_percent) || ')' END AS label FROM {_history_sql(_CURRENT)}""")
def history_labels(spark, d):
    found = deals.history_analysis(_current(spark, d), A.price_history(spark, d))
    return found.select("offer_id", deals.history_label(F.col("history_status"), F.col("history_drop_percent"), F.col("history_points")).alias("label"))


# ---- snapshots as a stream --------------------------------------------------------------------------


@query("""WITH e AS (SELECT '' || user_id // 10 AS c, '' || user_id % 10 AS m, value, event_type <> 'error' AS in_stock, ts FROM events),
latest AS (SELECT c, m, arg_max(struct_pack(value := value, in_stock := in_stock), (ts, value, in_stock)) AS s FROM e GROUP BY 1, 2),
good AS (SELECT c, m, s.value AS price, row_number() OVER (PARTITION BY c ORDER BY s.value, m) AS place FROM latest WHERE s.in_stock AND s.value > 0),
pairs AS (SELECT c, count(*) AS n, max(m) FILTER (WHERE place = 1) AS m1, max(price) FILTER (WHERE place = 1) AS p1, max(m) FILTER (WHERE place = 2) AS m2, max(price) FILTER (WHERE place = 2) AS p2 FROM good GROUP BY 1)
SELECT e.c AS canonical_product_id, coalesce(n, 0) AS n_merchants, m1 AS cheapest_merchant_id, p1 AS cheapest_price, m2 AS competitor_merchant_id, p2 AS competitor_price, (p2 - p1) / p2 * 100 AS gap_percent,
  CASE WHEN coalesce(n, 0) < 2 THEN 'insufficient' WHEN (p2 - p1) / p2 * 100 + 1e-9 >= 15 THEN 'candidate' ELSE 'normal' END AS outcome
FROM (SELECT DISTINCT c FROM e) e LEFT JOIN pairs ON pairs.c = e.c""")
def streamed_deals(spark, d):
    """Deal states of products after all snapshots went through as a stream, in four files out of order, a part of them twice."""
    e = A.table(spark, d, "events")
    u = F.col("user_id")
    rows = e.select(F.floor(u / 10).cast("string").alias("canonical_product_id"), (u % 10).cast("string").alias("merchant_id"), F.col("value").alias("price"), (F.col("event_type") != "error").alias("in_stock"), F.col("ts").cast("timestamp").alias("checked_at"), "event_id")
    again = rows.where(F.col("price") > 50)
    path = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    rows.unionByName(again).repartition(4, F.hash("event_id", "price")).drop("event_id").write.parquet(path)
    return stream_deals.final_states(stream_deals.run(spark, path)).drop("status", "version")


# ---- tables in buckets ----------------------------------------------------------------------------


@query(f"SELECT offer_id, current_price, history_points, history_avg_30d, history_low_90d, history_status FROM {_history_sql(_CURRENT)}")
def bucketed_history(spark, d):
    """Snapshots in buckets by offer: the last price of each offer and its history, without a shuffle."""
    history = buckets.bucketed(A.price_history(spark, d), "offer_id", "history")
    current = history.groupBy("offer_id").agg(F.max_by("price", F.struct("checked_at", "price")).alias("current_price"))
    return deals.history_analysis(current, history).select("offer_id", "current_price", "history_points", "history_avg_30d", "history_low_90d", "history_status")


@query(SQL["deal_feed"])
def bucketed_feed(spark, d):
    """The feed from offers in buckets: by variant for the join that finds deals, by id for the links of those shown."""
    offers = A.offers(spark, d)
    by_variant, links = buckets.bucketed(offers.select("id", "product_variant_id", "merchant_id", "price", "in_stock"), "product_variant_id", "offers"), buckets.bucketed(offers.select("id", "product_url"), "id", "links")
    canonical_products = A.canonical_products(spark, d)
    new = deals.run_deals(canonical_products, A.product_matches(spark, d), A.variants(spark, d), by_variant, A.price_history(spark, d), A.deal_candidates(spark, d))[0]
    feed = deals.deal_feed(new, canonical_products, links, A.merchants(spark, d))
    return feed.select("id", (F.col("title") != "Ürün").alias("titled"), "brand", "price", "competitor_price", "gap_percent", "merchant", "competitor_merchant", "product_url")
