import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import features as X
from bazaarlens.functions import text as T


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text,matching,listing,card",
    [
        ("Çocuk Matarası 500ML", "cocuk matarasi 500ml", "cocuk matarası 500ml", "çocuk matarası 500ml"),
        ("İSTANBUL Işık", "istanbul isik", "istanbul isık", "i stanbul işık"),
        ("Straße №5", "strasse o5", "strasse o5", "strasse 5"),
        ("KIRMIZI Kupa", "kirmizi kupa", "kirmizi kupa", "kirmizi kupa"),
        ("", "", "", ""),
        (None, "", "", ""),
    ],
)
def test_normalisation(spark, text, matching, listing, card):
    assert [values(spark, f, [text])[0] for f in (T.normalize_matching, T.normalize_listing, T.normalize_card)] == [matching, listing, card]


def tokens(text):
    return X.tokens(T.normalize_matching(text))


def test_volume(spark):
    cases = {
        "Quencher 1.18 L": 1180, "Mug 0,47L": 470, ".35 lt": 350, "500ml": 500, "12,5 ml": 12, "16 oz": 473, "40 oz": 1183, "Termos Bardak 0,89": 890, "Kalem 0,89": None,
        "5 ml": None, "10000 ml": None, "25 l": None, "1 LİTRE": None, "": None, None: None, "500 ml 2 l": 500,
    }
    assert values(spark, lambda x: X.volume_ml(x, tokens(x)), list(cases)) == list(cases.values())


def test_gtin(spark):
    cases = {"4006381333931": "4006381333931", "4006381333932": None, "12345670": "12345670", "036000291452": "036000291452", "00000000": "00000000", "1210001903470 -1": None, "123": None, "": None, None: None, "4006381-333931": "4006381333931"}
    assert values(spark, X.valid_gtin, list(cases)) == list(cases.values())
    assert values(spark, lambda x: X.valid_gtin(x, True), ["00000000"]) == [None]


def test_prices(spark):
    assert values(spark, T.price_currency, ["1.299,90 TL", "12345 TL", "1234.50 TL", "899 ₺", "none", None]) == [1299.90, 12345.0, 50.0, 899.0, None, None]
    assert values(spark, T.price_plain, ["1.299", "1.299,90", "x", None]) == [1.299, 1299.90, None, None]
    assert values(spark, T.price_turkish, ["1.299 TL", "12,50 TL", "", None]) == [1299.0, 12.5, None, None]
    assert values(spark, T.price_any, ["12,5", "1.299,90", "", None]) == [12.5, 1299.90, None, None]


def test_colours_and_models(spark):
    assert values(spark, lambda x: X.colours(tokens(x)), ["Mavi pembe Rose kupa", "kupa", None]) == [["blue", "pink"], [], []]
    got = values(spark, X.model_codes, ["Stanley 10-10824-019 AB123 MOR-TURUNCU", "a1 AB1", "12-34", "1-2-345", None, "İÇ-42X"])
    assert got == [["10-10824-019", "AB123"], [], [], ["1-2-345"], [], ["IC-42X"]]


def test_token_lists(spark):
    assert values(spark, lambda x: X.meaningful(tokens(x)), ["The Termos 12 Icon 500 a"]) == [["icon", "500"]]
    df = spark.sql("SELECT array('a','b') a, array('b','c','d') b, cast(array() as array<string>) e")
    row = df.select(X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("a"), F.col("e")), X.overlap(F.col("a"), F.col("b")), X.disjoint(F.col("a"), F.col("e"))).first()
    assert tuple(row) == (0.25, 0.0, 0.5, False)


def test_titles_and_addresses(spark):
    assert values(spark, T.clean_title, ["X Fiyatları ve Özellikleri", "Y - FIYATLARI VE ÖZELLIKLERI", "XY", None, " Z "])[0::2] == ["X", "XY", "Z"]
    assert values(spark, T.canonical_url, ["https://a/b;p=1?x=2#f", "https://a/b", None]) == ["https://a/b", "https://a/b", None]
    df = spark.createDataFrame([("https://a.b/c/d", "../e"), ("https://a.b/c", "//x/y"), (None, "z"), ("https://a.b", None)], "b string, x string")
    assert [r[0] for r in df.select(T.join_url("b", "x")).collect()] == ["https://a.b/e", "https://x/y", "z", None]
    assert values(spark, T.unescape_html, ["a &amp; b", None]) == ["a & b", None]
    assert values(spark, lambda x: T.truthy(x, F.lit("d")), ["", None, "v"]) == ["d", "d", "v"]
