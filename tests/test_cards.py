import pytest
from pyspark.sql import functions as F

from bazaarlens.functions.text import price_turkish
from bazaarlens.operators import cards
from bazaarlens.sources import envelopes


def card(pos=0, merchant="trendyol", hrefs=("/stanley/icon-p-77?x=1",), brand="Stanley Icon kupa", title="Icon kupa", alt=None, images=("//i/1", None), text="", nodes=()):
    return (merchant, "q", "https://www.trendyol.com/sr", pos, list(hrefs), brand, title, alt, list(images), text, [tuple(n) for n in nodes])


def items(spark, rows, **kw):
    return cards.card_items(spark.createDataFrame(rows, cards.CARDS), **kw).collect()


def test_price_of_nodes(spark):
    nodes = [("1.500 TL", "prc-box-orgnl old price", "", True, True), ("999,90 TL", "prc-box-dscntd", "", True, True), ("50 TL indirim", "price", "", True, True), ("1 TL", "price current", "", True, False)]
    (r,) = items(spark, [card(nodes=nodes)])
    assert (r.price, r.brand, r.merchant_product_id, r.product_url, r.image_url) == (999.9, "Stanley", "77", "https://www.trendyol.com/stanley/icon-p-77", "https://i/1")
    score = spark.createDataFrame([card(nodes=nodes)], cards.CARDS).select(F.transform("nodes", lambda n: cards.node_score(n))).first()[0]
    assert score == [35 - 140 + 20 + 15, 100 + 20 + 15, 35 - 180 + 20 + 15, 100 + 35 + 20 + 15]


@pytest.mark.parametrize("text,want", [("50 TL kupon\n1.299,90 TL\n5 TL", 1299.9), ("puan 5 TL", None), (None, None), ("12 TL", 12.0)])
def test_price_of_text(spark, text, want):
    (r,) = items(spark, [card(text=text)])
    assert r.price == want


def test_fallbacks_and_repeats(spark):
    rows = [card(0, brand=None), card(1, brand=None), card(2, hrefs=("javascript:x", "/b-c/d-p-5"), title="", alt="Alt name", brand=None), card(3, hrefs=("javascript:x",)), card(4, hrefs=("/e",), title=None), card(5, "hepsiburada", ("/x-p-hbcv0000",), None, "- Icon kupa")]
    got = {(r.merchant, r.title): (r.brand, r.merchant_product_id) for r in items(spark, rows)}
    assert got == {("trendyol", "Icon kupa"): ("Stanley", "77"), ("trendyol", "Alt name"): ("B C", "5"), ("hepsiburada", "- Icon kupa"): (None, "HBCV0000")}
    assert len(items(spark, rows, limit=1)) == 2 and items(spark, rows[:0]) == []


def test_listed_offers(spark):
    rows = [(1, "https://c/", [("Shop A 1.299 TL", [("/go", None, "Satıcıya git"), ("/a", "Shop A", ""), ("/b", "", "Seller B")]), ("12 TL", []), ("none", [])]), (2, "https://c/", [])]
    got = {r.id: r for r in cards.listed_offers(spark.createDataFrame(rows, cards.LISTED), price_turkish).collect()}
    assert (got[1].current_lowest_price, got[1].offer_count, got[2].current_lowest_price, got[2].offer_count) == (12.0, 2, None, 0)
    assert [(o.price, o.merchant, o.seller_name, o.url) for o in got[1].offers] == [(12.0, None, None, None), (1299.0, "Shop A", "Seller B", "https://c/go")]


def test_links_stand_in_for_missing_cards(spark):
    shop = lambda pos, query, href, text="9 TL": (*card(pos, "hepsiburada", (href,), "B", "Item", text=text)[:1], query, *card(pos, "hepsiburada", (href,), "B", "Item", text=text)[2:])
    shown = [shop(0, "a", "/one-p-HB1")]
    linked = [shop(0, "a", "/two-p-HB2"), shop(0, "b", "/nothing"), shop(1, "b", "/three-p-HB3"), shop(2, "b", "/three-p-HB3?again"), shop(3, "b", "/four-p-HB4", "no amount"), shop(4, "b", "/five-p-HB5")]
    frame = lambda rows: spark.createDataFrame(rows, cards.CARDS)
    got = cards.items_or_fallback(frame(shown), frame(linked)).collect()
    assert sorted((r.query, r.merchant_product_id) for r in got) == [("a", "HB1"), ("b", "HB3"), ("b", "HB5")]
    assert [r.merchant_product_id for r in cards.link_card_items(frame(linked[1:]), most_links=1).collect()] == ["HB3"]
    assert cards.items_or_fallback(frame(shown[:0]), frame(linked[:0])).collect() == []


def test_envelopes(spark, tmp_path):
    found = cards.card_items(spark.createDataFrame([card(), card(1, hrefs=("/x-p-5",), text="3 TL")], cards.CARDS))
    asked = spark.createDataFrame([("trendyol", "q"), ("trendyol", "q"), ("n11", "none")], "merchant string, query string")
    envelopes.write_envelopes(envelopes.envelopes(asked, found), f"file://{tmp_path}/out")
    got = {r.merchant: r for r in envelopes.read_envelopes(spark, f"file://{tmp_path}/out").collect()}
    assert (got["n11"]["ok"], got["n11"]["count"], got["n11"]["products"]) == (False, 0, [])
    assert (got["trendyol"]["ok"], got["trendyol"]["count"], sorted(x.merchant_product_id for x in got["trendyol"]["products"])) == (True, 2, ["5", "77"])
