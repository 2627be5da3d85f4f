"""Text normalisation, prices, titles and addresses as columns.

Normalisation needs Unicode decomposition and case folding, which Spark's functions lack; rows of
plain ASCII take a native path in the same expression, so Python sees the other rows' values only
where they are not ASCII (as nulls otherwise).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .words import TITLE_SUFFIXES


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold().strip()) if not unicodedata.combining(c))


def fold_matching(text: str) -> str:
    """For matching: folded, marks dropped, dotless i as i, a-z and 0-9 kept."""
    return re.sub("[^a-z0-9]+", " ", _fold(text).replace("ı", "i")).strip()


def fold_listing(text: str) -> str:
    """For listings read from pages: as for matching, but Turkish letters that survive folding stay."""
    return re.sub("[^a-z0-9çğıöşü]+", " ", _fold(text)).strip()


def fold_card(text: str) -> str:
    """For cards of rendered pages: case folded only, Turkish letters stay."""
    return re.sub("[^a-z0-9çğıöşü]+", " ", text.casefold()).strip()


def _normaliser(fold: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def fold_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else fold(x))

    def column(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        ascii_only = text.rlike(r"^[\x00-\x7F]*$")
        native = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
        return F.when(ascii_only, native).otherwise(fold_all(F.when(~ascii_only, text)))

    return column


normalize_matching = _normaliser(fold_matching)
normalize_listing = _normaliser(fold_listing)
normalize_card = _normaliser(fold_card)


def brand_key(brand: Column) -> Column:
    return F.replace(normalize_matching(brand), F.lit(" "), F.lit(""))


@F.pandas_udf(StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return texts.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link resolved against its page's address."""

    def joined(b, x):
        try:
            return None if x is None else urljoin(b or "", x)
        except ValueError:
            return None

    return pd.Series([joined(b, x) for b, x in zip(base, link)], dtype=object)


def canonical_url(url: Column) -> Column:
    """Without query, fragment and parameters of the last path segment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r";[^/]*$", "")


def _number(text: Column) -> Column:
    return text.try_cast("double")


# How amounts are written, with a currency and without.
AMOUNT_WITH_CURRENCY = r"(?i)(\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?|\d+(?:,\d{1,2})?)\s*(?:TL|₺)"
TURKISH_AMOUNT = r"(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d{1,2}))?"


def price_currency(text: Column) -> Column:
    """The first amount before TL or the lira sign; points group, a comma is decimal: ``1.299,90 TL``."""
    amount = F.regexp_extract(F.coalesce(text, F.lit("")), AMOUNT_WITH_CURRENCY, 1)
    return _number(F.replace(F.replace(F.nullif(amount, F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def price_plain(text: Column) -> Column:
    """A bare value: only with a comma do points group; ``1.299`` is 1.299."""
    bare = F.trim(F.replace(F.replace(text.cast("string"), F.lit("TL"), F.lit("")), F.lit("₺"), F.lit("")))
    grouped = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _number(F.when(bare.contains(","), grouped).otherwise(bare))


def price_turkish(text: Column) -> Column:
    """Points group and a comma is decimal, with or without a currency: ``1.299 TL`` is 1299."""
    amount = F.regexp_extract(F.coalesce(text, F.lit("")), TURKISH_AMOUNT, 0)
    return _number(F.replace(F.replace(F.nullif(amount, F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def price_any(text: Column) -> Column:
    """With both signs a point groups; a lone comma is decimal; a lone point is decimal."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9,.]", "")
    both = kept.contains(",") & kept.contains(".")
    shaped = F.when(both, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(kept, F.lit(","), F.lit(".")))
    return _number(F.nullif(shaped, F.lit("")))


def clean_title(title: Column) -> Column:
    """Without the shops' endings and the dashes before them."""
    out = F.trim(F.coalesce(title, F.lit("")))
    for suffix in TITLE_SUFFIXES:
        has = F.endswith(F.lower(out), F.lit(suffix.lower()))
        out = F.when(has, F.regexp_replace(F.substring(out, F.lit(1), F.length(out) - len(suffix)), r"^[ -]+|[ -]+$", "")).otherwise(out)
    return out


def truthy(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
