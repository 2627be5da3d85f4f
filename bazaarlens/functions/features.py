"""What is read from a title: tokens, volume, colours, model codes; and check digits of GTINs. Native columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .words import COLOUR_FAMILY, STOPWORDS, VOLUME_CONTEXT

# How amounts of each unit and model codes are written.
MILLILITRES = r"(?U)(?<![\d.,])(\d{2,4}(?:[.,]\d+)?)\s*ml\b"
LITRES = r"(?U)(?<![\d.,])(\d+[.,]\d+|[.,]\d+|\d+)\s*l(?:t|itre|iter)?\b"
OUNCES = r"(?U)(?<![\d.,])(\d+[.,]\d+|\d+)\s*oz\b"
BARE_DECIMAL = r"(?U)(?<![\d.,])(\d+[.,]\d+|[.,]\d+)(?![\d.,])"
MODEL_CODE = r"(?U)\b[A-Z0-9]+(?:-[A-Z0-9]+)+\b|\b[A-Z]{1,8}\d{2,}[A-Z0-9]*\b"


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(normalized: Column) -> Column:
    """Tokens of two characters or more."""
    return F.filter(F.split(normalized, " "), lambda t: F.length(t) >= 2)


def meaningful(tokens_: Column) -> Column:
    """Without stop words and numbers of one or two digits."""
    return F.filter(F.array_except(tokens_, _strings(STOPWORDS)), lambda t: ~t.rlike("^[0-9]{1,2}$"))


def colours(tokens_: Column) -> Column:
    """Colour families of the colour words, in order of the alphabet."""
    family = F.create_map(*[F.lit(x) for pair in COLOUR_FAMILY.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(F.array_intersect(tokens_, _strings(COLOUR_FAMILY)), lambda t: family[t])))


@F.pandas_udf(StringType())
def _upper_plain(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.upper()) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else x.casefold())


def _by_ascii(text: Column, native, other) -> Column:
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, native(text)).otherwise(other(F.when(~plain, text)))


def _decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def volume_ml(title: Column, tokens_: Column) -> Column:
    """Millilitres: from ml, else litres up to 20, else ounces, else a bare decimal from 0.10 to 5.0 (litres)
    where the title speaks of a vessel. The first hit of a unit counts; halves go to the even number."""
    raw = _by_ascii(title, F.lower, _casefold)
    hit = lambda pattern: F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))
    ml = _decimal(hit(MILLILITRES))
    litres = _decimal(hit(LITRES))
    ounces = _decimal(hit(OUNCES))
    bare = F.regexp_extract_all(raw, F.lit(BARE_DECIMAL), F.lit(1))
    bare = F.filter(F.transform(bare, _decimal), lambda x: (x >= 0.10) & (x <= 5.0))
    vessel = F.arrays_overlap(tokens_, _strings(VOLUME_CONTEXT))
    return F.coalesce(
        F.bround(ml), F.when((litres > 0) & (litres <= 20), F.bround(litres * 1000)), F.bround(ounces * 29.5735), F.when(vessel, F.bround(F.get(bare, 0) * 1000))
    ).cast("int")


def model_codes(title: Column) -> Column:
    """Codes with hyphens, or letters with two digits or more; not phrases of colours, not shorter than four
    signs, and without letters only with two hyphens."""
    raw = _by_ascii(title, F.upper, _upper_plain)
    found = F.regexp_extract_all(raw, F.lit(MODEL_CODE), F.lit(0))
    words = _strings([w.upper() for w in COLOUR_FAMILY])

    def good(code: Column) -> Column:
        parts = F.filter(F.split(code, "-"), lambda p: p != "")
        compact = F.replace(code, F.lit("-"), F.lit(""))
        hyphens = F.length(code) - F.length(compact)
        return (F.size(F.array_except(parts, words)) > 0) & (F.length(compact) >= 4) & (compact.rlike("[A-Z]") | (hyphens >= 2))

    return F.array_sort(F.array_distinct(F.filter(found, good)))


def valid_gtin(value: Column, reject_zero: bool = False) -> Column:
    """The digits, if there are 8, 12, 13 or 14 and the last one is the check digit; else null."""
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\D", "")
    body = F.reverse(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""))
    weighed = F.aggregate(F.transform(body, lambda d, k: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(k % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, b: a + b)
    expected = F.pmod(F.lit(10) - F.pmod(weighed, F.lit(10)), F.lit(10))
    fine = F.length(digits).isin(8, 12, 13, 14) & (F.substring(digits, -1, 1).try_cast("int") == expected)
    if reject_zero:
        fine = fine & ~digits.rlike("^0+$")
    return F.when(fine, digits)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared codes over those of the shorter list; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def disjoint(a: Column, b: Column) -> Column:
    """Both hold something and nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
