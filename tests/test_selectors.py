from pyspark.sql import functions as F

from bazaarlens.operators import cards, selectors
from bazaarlens.operators.selectors import Selector


def read(spark, html, merchant="trendyol"):
    return selectors.page_cards(spark.createDataFrame([(merchant, "q", "https://www.trendyol.com/sr", html)], "merchant string, query string, page_url string, html string"))


def test_elements():
    found = selectors.elements('<div CLASS="a b" class=c><p>one<br>two <b>x &amp; y</b></p><img src=1><script>no</script></i><span style="display: none">gone</span></div>tail')
    assert [(e["tag"], e["above"], e["last"]) for e in found] == [("div", [], 6), ("p", [0], 3), ("br", [0, 1], 2), ("b", [0, 1], 3), ("img", [0], 4), ("script", [0], 5), ("span", [0], 6)]
    assert found[0]["text"] == "one\ntwo x & y" and found[0]["attributes"] == {"class": "a b"} and [e["leaf"] for e in found] == [False, False, True, True, True, True, True]
    assert not found[6]["visible"] and selectors.elements(None) == [] and selectors.elements("text") == []
    assert [(e["tag"], e["last"]) for e in selectors.elements("<ul><li>a<b>c</ul><p>d")] == [("ul", 2), ("li", 2), ("b", 2), ("p", 3)]


def test_order_of_preference(spark):
    html = '<i class="x y"></i><u class="xy" data-k="">first</u><i class="x" data-k="5">second</i><div id="d"><i><b>deep</b></i></div>'
    rows = spark.createDataFrame([(html,)], "html string").select(selectors.read_elements("html").alias("e"))
    e = F.col("e")
    text = lambda *s: selectors.first_text(e, list(s), e)
    deep, child = Selector("b", inside=Selector("div", "id", "is", "d")), Selector("b", inside=Selector("div", "id", "is", "d"), child=True)
    got = rows.select(
        text(Selector("", "class", "word", "x")), text(Selector("", "class", "word", "x"), Selector("", "class", "starts", "xy")), text(Selector("", "class", "holds", "xy")), text(deep), text(child),
        selectors.first_attribute(e, [Selector("u", "data-k")], "data-k", e), selectors.first_attribute(e, [Selector("u"), Selector("i", "data-k", "is", "5")], "data-k", e),
    ).first()
    # only a selector's first element counts; an empty text or attribute goes on to the next selector
    assert tuple(got) == (None, "first", "first", "deep", None, None, "5")


def test_cards_of_a_page(spark):
    one = '<div class="p-card-wrppr w"><a href="javascript:x">z</a><a href="/m/i-p-7?a=1"><img data-src="//i/7"></a><span class=prdct-desc-cntnr-name> </span><b class="product-name">Icon <i>kupa</i></b>'
    one += '<s class="price old">1.500 TL</s><div class="prc-box-dscntd">999,90 TL</div><em class="price current" style="visibility:hidden">1 TL</em></div>'
    two = '<DIV class="p-card-wrppr"><a href=/m/x-p-8><img alt="Alt" src="//i/8"></a>50 TL kupon<br>12 TL</DIV>'
    got = cards.card_items(read(spark, f"<html>{one}<p class=product-card>not of the first selector</p>{two}")).orderBy("product_url").collect()
    assert [(r.title, r.price, r.image_url, r.product_url, r.merchant_product_id) for r in got] == [
        ("Icon kupa", 999.9, "https://i/7", "https://www.trendyol.com/m/i-p-7", "7"), ("Alt", 12.0, "https://i/8", "https://www.trendyol.com/m/x-p-8", "8"),
    ]


def test_price_of_selectors_before_text(spark):
    html = """<div class="list productListContent-x"><div><a href="/a-p-HBC1">g</a><h2 class="title-module_titleRoot-1"><span>Name</span> more</h2><div class="price-module_finalPrice-2"></div>
      <p data-test-id="price-current-price">sepette indirim 1.250,50 TL</p>9 TL</div><div><a href="/b-p-HBC2"><h3>Other</h3></a><p>kupon 5 TL</p>7,50 ₺</div></div>"""
    got = cards.card_items(read(spark, html, "hepsiburada")).orderBy("title").collect()
    assert [(r.title, r.price) for r in got] == [("Name", 1250.5), ("Other", 7.5)]


def test_pages_without_cards(spark):
    for html, merchant in ((None, "trendyol"), ("", "hepsiburada"), ("<p>none</p>", "trendyol"), ('<p class="product-card"></p>', "elsewhere")):
        assert read(spark, html, merchant).collect() == []
    (empty,) = read(spark, '<p class="product-card"></p>').collect()
    assert (empty.title, empty.hrefs, empty.nodes, empty.card_text) == (None, [], [], "")


def test_pages_are_read_a_few_at_once(spark, monkeypatch):
    """However many pages come in a batch, the elements of a few are held and sent."""
    rows = spark.range(0, 100, 1, 1).select(F.lit("trendyol").alias("merchant"), F.col("id").cast("string").alias("query"), F.lit("u").alias("page_url"), F.lit("<p>x</p>").alias("html"))
    sizes = []
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, read, schema: sizes.extend(len(b) for b in read(iter([self.toPandas()]))) or self)
    selectors.read_pages(rows)
    assert sum(sizes) == 100 and max(sizes) <= selectors.AT_ONCE
