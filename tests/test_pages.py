import json

from pyspark.sql import functions as F

from bazaarlens.functions import markup
from bazaarlens.operators import pages

PAGES = "merchant string, query string, kind string, url string, html string, pos int"


def ld(*objects):
    return "<html><head>" + "".join(f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>' for o in objects) + "</head><body></body></html>"


def product(**fields):
    return {"@type": "Product", "name": "Icon Kupa 500 ml", "sku": "S1", "offers": {"price": "1.299,90"}} | fields


def items(spark, rows):
    return pages.parsed_items(spark.createDataFrame(rows, PAGES)).collect()


def page(html, merchant="n11", query="icon", url="https://www.n11.com/urun/icon-77", pos=0):
    return (merchant, query, "product", url, html, pos)


def test_json_ld_shapes():
    assert markup.product_objects(ld("{bad", {"@graph": [{"@type": "Thing"}, product(sku="G")]}))[0]["sku"] == "G"
    assert markup.product_objects(ld({"@type": ["Other", "Product"], "sku": "L"}))[0]["sku"] == "L"
    assert len(markup.product_objects(ld(product(sku="1"), product(sku="2")))) == 2
    assert markup.product_objects(ld({"@type": "Thing"})) == [] and markup.product_objects(None) == []


def test_items(spark):
    (r,) = items(spark, [page(ld(product(brand={"name": "Stanley"}, image=["https://i/1"], gtin13="x4006381333931", offers=[{"a": 1}, {"lowPrice": 12.5, "availability": "https://schema.org/OutOfStock"}])))])
    assert (r.merchant_product_id, r.brand, r.price, r.image_url, r.in_stock, r.gtin) == ("S1", "Stanley", 12.5, "https://i/1", False, "4006381333931")
    (r,) = items(spark, [page(ld(product(sku="", offers={"price": 0, "lowPrice": "7"})))])
    assert (r.merchant_product_id, r.price, r.in_stock, r.brand) == ("77", 7.0, True, None)
    assert items(spark, [page(ld(product(name=""))), page(ld(product(offers={}))), page("<html></html>"), page(None)]) == []
    (r,) = items(spark, [page(ld(product(brand="B")), "vatan", "ICON", "https://www.vatanbilgisayar.com/a.html")])
    assert r.brand == "B" and r.price == 1299.9


def test_relevance_and_repeats(spark):
    rows = [page(ld(product(sku=s, name=n)), "mediamarkt", "icon kupa", f"https://www.mediamarkt.com.tr/tr/product/{k}.html", k) for k, (s, n) in enumerate([("1", "Icon Kupa"), ("1", "Icon Kupa again"), ("2", "Other thing"), ("3", "kupa")])]
    assert sorted(r.merchant_product_id for r in items(spark, rows)) == ["1", "3"]


def test_gallery(spark):
    html = ld(product(image="https://ld/x")).replace("<body>", '<body><img src="https://n11scdn/a_600_600.jpg" alt="Icon Kupa 500 ml mavi"><img data-src="//n11scdn/IMG-b.jpg" alt=""><img src="https://else/org">')
    (r,) = items(spark, [page(html)])
    assert r.image_url == "https://n11scdn/a_600_600.jpg"


def test_links(spark):
    html = '<a href="/urun/a-1?x=1">A <b>b</b></a><a href="/urun/a-1#y">again</a><a href="/other">o</a><a>none</a><a href="https://www.n11.com/urun/c-2" title="C">c</a>'
    df = spark.createDataFrame([("n11", "q", "search", "https://www.n11.com/arama?q=q", html, 0), ("vatan", "q", "search", "https://www.vatanbilgisayar.com/", '<a href="/kategori/a.html">k</a><a href="/b.html">b</a>', 0)], PAGES)
    got = {(r.merchant, r.url) for r in pages.product_links(df).collect()}
    assert got == {("n11", "https://www.n11.com/urun/a-1"), ("n11", "https://www.n11.com/urun/c-2"), ("vatan", "https://www.vatanbilgisayar.com/b.html")}
    assert pages.product_links(df, limit=1).count() == 2
    first = pages.exploded_links(df, ["merchant"]).where("merchant = 'n11'").orderBy("pos").first()
    assert (first.pos, first.href, first.text) == (0, "/urun/a-1?x=1", "A b")


def test_small_columns(spark):
    df = spark.range(1)
    assert df.select(pages.marketplace_of(F.lit("https://www.n11.com/x"), {"n11.com": "n11", "vatan": "Vatan"})).first()[0] == "n11"
    assert df.select(pages.is_blocked(F.lit("<p>Please solve the CAPTCHA</p>"), F.lit(None))).first()[0]


def offer(price, url, seller="shop/A"):
    return f'{{"@type":"Offer","availability":"x","price":"{price}","url":"{url}","seller":{{"@type":"Organization","name":"{seller}"}}}}'


def test_comparison_pages(spark):
    html = offer("12.5", "https://www.n11.com/1?u=2") + offer("12.5", "https://www.n11.com/1?u=3") + offer("9", "https://y/2", "B") + offer("0", "https://z") + offer("5", "https://own.com/x") + offer("5", "/rel")
    state = '[0,{"code":[0,1],"name":[0,"First product"],"price":[0,10.5],"url":[0,"/p,1.html"],"mkName":[0,"B"],"vdName":[0,"V"]}] [0,{"code":[0,2],"name":[0,"First product"],"price":[0,11],"url":[0,"/p,1.html"]}] [0,{"code":[0,3],"name":[0,"abc"],"price":[0,1]}]'
    df = spark.createDataFrame([(1, html), (2, state.replace('"', "&quot;")), (3, None)], "id int, html string")
    rows = pages.comparison_offers(df, ["id"], "own.com").orderBy("place").collect()
    assert [(r.price, r.seller, r.marketplace, r.url) for r in rows] == [(9.0, "B", "Other", "https://y/2"), (12.5, "A", "n11", "https://www.n11.com/1?u=2")]
    (p,) = pages.comparison_products(df, ["id"], "https://own.com").collect()
    assert (p.id, p.name, p.price, p.brand, p.vendor, p.url, p.code) == (2, "First product", 10.5, "B", "V", "https://own.com/p,1.html", "1")


def test_title_confirms(spark):
    df = spark.createDataFrame([("Icon Kupa Stanley | Shop", "Stanley Icon kupa"), ("Kategori", "Stanley Icon"), (None, None)], "t string, n string")
    assert [r[0] for r in df.select(pages.title_confirms(F.col("t"), F.col("n"))).collect()] == [True, False, False]


def test_ids_by_pattern(spark):
    url = "https://www.hepsiburada.com/icon-p-hbcv00001"
    rows = [page(ld(product(sku="hbv0000ab")), "hepsiburada", url=url, pos=0), page(ld(product(sku="other")), "hepsiburada", url=url + "2", pos=1)]
    assert sorted(r.merchant_product_id for r in items(spark, rows)) == ["HBCV000012", "HBV0000AB"]


def test_search_addresses(spark):
    df = spark.createDataFrame([("Çelik Termos",), ("icon kupa",)], "q string")
    assert [r[0] for r in df.select(pages.search_url(F.col("q"), {"termos": "https://x/termos"}, "https://x/ara?q=")).collect()] == ["https://x/termos", "https://x/ara?q=icon%20kupa"]


def test_pages_are_parsed_by_many_tasks(spark, sf):
    """However few parts the table of their parts is read in."""
    from bazaarlens import page_queries

    assert page_queries.product_pages(spark, sf).rdd.getNumPartitions() >= 200
    assert page_queries.page_products(spark, sf).rdd.getNumPartitions() >= 200
