"""Search pages as raw HTML to cards: selectors in order of preference, with attributes where texts are missing.

A page is parsed once, into an array of its elements in document order (``read_pages``, Python); which elements are
cards and what is taken from each are columns. ``page_cards`` gives rows of ``cards.CARDS``, so ``cards.card_items``
goes on from there.

An element carries the text below it, so a page takes as much memory as its text times the depth of its elements.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructType

from .cards import MONEY

ELEMENTS = ArrayType(
    StructType().add("pos", IntegerType()).add("tag", StringType()).add("attributes", MapType(StringType(), StringType())).add("above", ArrayType(IntegerType()))
    .add("last", IntegerType()).add("text", StringType()).add("leaf", BooleanType()).add("visible", BooleanType())
)
# Elements of HTML without an end, elements that stand on lines of their own, elements that show no text.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
BLOCKS = ["address", "article", "br", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "section", "table", "tr", "ul"]
SILENT = ["head", "noscript", "script", "style", "template"]


@dataclass(frozen=True)
class Selector:
    """Elements by tag and one attribute; ``how`` is ``has``, ``is``, ``starts``, ``holds`` or ``word``."""

    tag: str = ""
    attribute: str = ""
    how: str = "has"
    value: str = ""
    #: What an element above must fit; the one right above if ``child``.
    inside: Selector | None = None
    child: bool = False


# What cards are, and where their parts stand, by merchant, in order of preference.
CARD = {
    "trendyol": [Selector("", "class", "word", "p-card-wrppr"), Selector("", "data-testid", "is", "product-card-wrapper"), Selector("", "class", "word", "product-card")],
    "hepsiburada": [
        Selector("li", "class", "starts", "productListContent-"), Selector("", "data-test-id", "is", "product-card"), Selector("", "data-testid", "is", "product-card"),
        Selector("li", "class", "holds", "productListContent"), Selector("div", inside=Selector("div", "class", "holds", "productListContent"), child=True),
    ],
}
LINK = {
    "trendyol": [Selector("a", "href", "holds", "-p-"), Selector("a", "href", "holds", "/p-"), Selector("a", "href")],
    "hepsiburada": [Selector("a", "href", "holds", "-p-HBC"), Selector("a", "href", "holds", "/p-HBC"), Selector("a", "href", "holds", "HBCV"), Selector("a", "href", "holds", "HBC000"), Selector("a", "href")],
}
TITLE = {
    "trendyol": [
        Selector("", "class", "word", "prdct-desc-cntnr-name"), Selector("", "class", "word", "prdct-desc-cntnr"), Selector("", "class", "holds", "product-name"),
        Selector("", "class", "holds", "title"), Selector("", "data-testid", "holds", "name"),
    ],
    "hepsiburada": [
        Selector("span", inside=Selector("h2", "class", "starts", "title-module_titleRoot")), Selector("", "data-test-id", "is", "product-card-name"), Selector("", "data-testid", "is", "product-card-name"),
        Selector("h3"), Selector("h2"), Selector("", "class", "holds", "title"), Selector("", "class", "holds", "name"),
    ],
}
BRAND = {
    "trendyol": [Selector("", "class", "word", "prdct-desc-cntnr-ttl"), Selector("", "class", "holds", "brand"), Selector("", "data-testid", "holds", "brand")],
    "hepsiburada": [Selector("", "data-test-id", "holds", "brand"), Selector("", "data-testid", "holds", "brand"), Selector("", "class", "holds", "brand")],
}
#: Where the first that has a text gives the price.
PRICE = {
    "hepsiburada": [
        Selector("div", "class", "starts", "price-module_finalPrice"), Selector("", "data-test-id", "is", "price-current-price"), Selector("", "data-testid", "is", "price-current-price"),
        Selector("", "data-test-id", "holds", "price"), Selector("", "data-testid", "holds", "price"), Selector("", "class", "holds", "finalPrice"), Selector("", "class", "holds", "sellingPrice"),
    ],
}
#: Where all are scored.
PRICE_NODES = {"trendyol": [Selector("", "data-testid", "holds", "price"), *(Selector("", "class", "holds", w) for w in ["price", "Price", "prc-", "selling", "discounted"])]}


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[int] = []
        self.said: list[str] = []  # pieces of text, in document order
        self.starts: list[int] = []  # how many pieces stand before an element
        self.ends: list[int] = []

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in reversed(attrs)}  # of a repeated attribute the first counts
        style = "".join(at.get("style", "").lower().split())
        above = self.found[self.open[-1]] if self.open else None
        gone = "display:none" in style or "hidden" in at or tag in SILENT or bool(above and above["gone"])
        unseen = "visibility:hidden" in style or bool(above and above["unseen"])
        if above:
            above["leaf"] = False
        if tag in BLOCKS:
            self.said.append("\n")
        pos = len(self.found)
        own = not ("display:none" in style or "hidden" in at or unseen)
        self.found.append({"pos": pos, "tag": tag, "attributes": at, "above": list(self.open), "last": pos, "leaf": True, "visible": own, "gone": gone, "unseen": unseen})
        self.starts.append(len(self.said))
        self.ends.append(len(self.said))
        if tag not in VOID:
            self.open.append(pos)

    def handle_endtag(self, tag):
        if tag in VOID or not any(self.found[k]["tag"] == tag for k in self.open):
            return  # an end without a start
        while self._shut() != tag:
            pass

    def _shut(self) -> str:
        k = self.open.pop()
        self.found[k]["last"], self.ends[k] = len(self.found) - 1, len(self.said)
        if self.found[k]["tag"] in BLOCKS:
            self.said.append("\n")
        return self.found[k]["tag"]

    def handle_data(self, data):
        above = self.found[self.open[-1]] if self.open else None
        if not (above and (above["gone"] or above["unseen"])):
            self.said.append(" ".join(data.split("\n")))

    def elements(self) -> list[dict]:
        while self.open:
            self._shut()
        for e, start, end in zip(self.found, self.starts, self.ends):
            lines = (" ".join(x.split(" ")).strip() for x in "".join(self.said[start:end]).split("\n"))
            e["text"] = "\n".join(x for x in lines if x)
        return self.found


def elements(html: str | None) -> list[dict]:
    """The elements of a page in document order: attributes, positions of those above, position of the last one below,
    the shown text below with a line for each block, whether it holds no other, whether its own style shows it."""
    page = _Elements()
    page.feed(html or "")
    page.close()
    return [{f.name: e[f.name] for f in ELEMENTS.elementType.fields} for e in page.elements()]


@F.pandas_udf(ELEMENTS)
def read_elements(html: pd.Series) -> pd.Series:
    return html.map(elements)


#: Pages whose elements a task holds at once.
AT_ONCE = 16


def read_pages(pages: DataFrame) -> DataFrame:
    """``(merchant, query, page_url, page)``: pages with their elements in place of their HTML, a few at once, however many
    come in a batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), AT_ONCE):
                some = batch.iloc[start : start + AT_ONCE]
                yield some[["merchant", "query", "page_url"]].assign(page=some["html"].map(elements))

    rows = pages.select(*[F.col(c).cast("string").alias(c) for c in ("merchant", "query", "page_url", "html")])
    schema = StructType().add("merchant", StringType()).add("query", StringType()).add("page_url", StringType()).add("page", ELEMENTS)
    return rows.mapInPandas(read, schema)


def fits(element: Column, selector: Selector, page: Column) -> Column:
    """Whether an element of a page is one that the selector means."""
    good = element["tag"] == selector.tag if selector.tag else F.lit(True)
    if selector.attribute:
        value = F.element_at(element["attributes"], F.lit(selector.attribute))
        wanted = F.lit(selector.value)
        test = {
            "has": value.isNotNull(), "is": value == wanted, "starts": value.startswith(wanted), "holds": value.contains(wanted),
            "word": F.array_contains(F.split(value, r"\s+"), wanted),
        }[selector.how]
        good = good & F.coalesce(test, F.lit(False))
    if selector.inside:
        above = F.slice(element["above"], -1, 1) if selector.child else element["above"]
        above = F.when(F.size(element["above"]) > 0, above).otherwise(F.array().cast("array<int>"))
        good = good & F.exists(above, lambda k: fits(F.get(page, k), selector.inside, page))
    return good


def _means(below: Column, selector: Selector, page: Column) -> Column:
    return F.filter(below, lambda e: fits(e, selector, page))


def first_text(below: Column, selectors: list[Selector], page: Column) -> Column:
    """The text of the first element that a selector means, of the first selector whose text isn't empty; else null."""
    return F.coalesce(*[F.nullif(F.get(_means(below, s, page), 0)["text"], F.lit("")) for s in selectors])


def first_attribute(below: Column, selectors: list[Selector], name: str, page: Column) -> Column:
    """Likewise an attribute."""
    return F.coalesce(*[F.nullif(F.element_at(F.get(_means(below, s, page), 0)["attributes"], F.lit(name)), F.lit("")) for s in selectors])


def _card(card: Column, page: Column, merchant: str) -> Column:
    below = F.slice(page, card["pos"] + 2, card["last"] - card["pos"])
    own = F.when(card["tag"] == "a", F.element_at(card["attributes"], F.lit("href")))
    image = [Selector("img")]
    if merchant in PRICE_NODES:
        any_of = lambda e: F.exists(F.array(*[fits(e, s, page) for s in PRICE_NODES[merchant]]), lambda x: x)
        label = lambda e, name: F.coalesce(F.element_at(e["attributes"], F.lit(name)), F.lit(""))
        nodes = F.transform(
            F.filter(below, any_of),
            lambda e: F.struct(
                e["text"].alias("text"), F.concat_ws(" ", label(e, "class"), label(e, "data-testid")).alias("meta"), F.get(page, F.element_at(e["above"], -1))["text"].alias("parent"), e["leaf"].alias("leaf"), e["visible"].alias("visible")
            ),
        )
    else:  # the amount alone, so that words around it don't count
        amount = F.nullif(F.regexp_extract(first_text(below, PRICE[merchant], page), MONEY, 0), F.lit(""))
        nodes = F.filter(F.array(F.struct(amount.alias("text"), F.lit("current").alias("meta"), F.lit("").alias("parent"), F.lit(True).alias("leaf"), F.lit(True).alias("visible"))), lambda n: n["text"].isNotNull())
    return F.struct(
        F.array_compact(F.array(own, *[first_attribute(below, [s], "href", page) for s in LINK[merchant]])).alias("hrefs"), first_text(below, BRAND[merchant], page).alias("brand_text"), first_text(below, TITLE[merchant], page).alias("title"),
        first_attribute(below, image, "alt", page).alias("image_alt"), F.array(*[first_attribute(below, image, name, page) for name in ("src", "data-src")]).alias("images"), card["text"].alias("card_text"), nodes.alias("nodes"),
    )


def _cards(chosen: Column, page: Column, merchant: str) -> Column:
    return F.transform(chosen, lambda c: _card(c, page, merchant))


def page_cards(pages: DataFrame) -> DataFrame:
    """Rows of ``cards.CARDS`` of ``(merchant, query, page_url, html)``: of a page the elements of the first card
    selector that means any. A page without cards, of another merchant or without HTML gives none."""
    read = read_pages(pages.where(F.col("merchant").isin(list(CARD))))
    page, of = F.col("page"), None
    for merchant, selectors in CARD.items():
        choices = [_means(page, s, page) for s in selectors]
        chosen = F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices])
        made = _cards(chosen, page, merchant)
        of = F.when(F.col("merchant") == merchant, made) if of is None else of.when(F.col("merchant") == merchant, made)
    return read.select("merchant", "query", "page_url", F.posexplode(of).alias("pos", "card")).select("merchant", "query", "page_url", "pos", "card.*")
