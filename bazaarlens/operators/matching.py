"""Entity resolution of offers across merchants: features, pairs, scores, clusters."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import DEFAULT, Settings
from ..functions import features as X
from ..functions.text import brand_key, normalize_matching, truthy
from ..plans.components import connected_components
from ..plans.linkage import BLOCK, complete_linkage, linked_by_kinds
from ..plans.storage import materialize

#: Parts of a heuristic score: base, title similarity (text ratio and shared words), model codes, and what
#: agreeing volumes and shared model codes add. Fixed values.
BASE, TITLE, RATIO_SHARE, WORDS_SHARE, MODEL, VOLUME_BONUS, MODEL_BONUS, MOST = 48.0, 34.0, 0.45, 0.55, 12.0, 6.0, 5.0, 99.0


def offer_rows(merchants: DataFrame, products: DataFrame, variants: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers in stock with their variant, product and merchant; a missing price is 0."""
    variant = variants.select(F.col("id").alias("product_variant_id"), "product_id", "gtin", "sku")
    product = products.select(F.col("id").alias("product_id"), "brand", "title")
    merchant = merchants.select(F.col("id").alias("merchant_id"), truthy(F.col("name"), F.col("slug")).alias("merchant"))
    # variants learn their product before they meet offers, which are shuffled once
    rows = offers.where("in_stock").join(variant.join(product, "product_id"), "product_variant_id").join(merchant, "merchant_id")
    return rows.select(
        F.col("id").alias("offer_id"), "product_variant_id", "product_id", "merchant_id", "merchant", "merchant_product_id", "brand", F.coalesce("title", F.lit("")).alias("title"), "gtin", "sku",
        F.coalesce("price", F.lit(0.0)).alias("price"), truthy(F.col("currency"), F.lit("TRY")).alias("currency"), "product_url",
    )


#: What features are made of.
LISTING = ("title", "brand", "gtin")


def listings(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Features of each distinct title, brand and GTIN."""
    named = rows.select(*LISTING).distinct().withColumn("norm", normalize_matching(F.col("title"))).withColumn("tokens", X.tokens(F.col("norm")))
    return named.withColumns(
        {
            "brand_key": brand_key(F.col("brand")), "words": F.array_sort(F.array_distinct(X.meaningful(F.col("tokens")))), "volume": X.volume_ml(F.col("title"), F.col("tokens")), "colours": X.colours(F.col("tokens")),
            "models": X.model_codes(F.col("title")), "valid_gtin": X.valid_gtin(F.col("gtin"), settings.reject_zero_gtin),
        }
    )


def _of_listing(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with what is known of their listing."""
    same = [F.col(f"row.{c}").eqNullSafe(F.col(f"listing.{c}")) for c in LISTING]
    made = [F.col(f"listing.{c}") for c in named.columns if c not in LISTING]
    return rows.alias("row").join(named.alias("listing"), same).select("row.*", *made)


def with_features(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Features of each row, before any pair is made; they are computed once for rows of equal title, brand and GTIN."""
    return _of_listing(rows, listings(rows, settings))


@F.pandas_udf(DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of two texts is in matching blocks; the first text is the one of the smaller offer id."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


#: Signs that are counted for a bound on the text ratio; all others count as one kind.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS comes in a text, and how many other signs there are."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*each, F.length(F.translate(text, LETTERS, "")))


def most_ratio(a: Column, b: Column) -> Column:
    """A bound on the text ratio of two texts, by ``letter_counts``: no more signs match than both have."""
    signs = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)
    both = signs(F.zip_with(a, b, lambda m, n: F.least(m, n)))
    total = signs(a) + signs(b)
    return F.when(total == 0, 1.0).otherwise(2 * both / total)


def least_jaccard(settings: Settings = DEFAULT) -> float:
    """The share of common words that a pair without a common model code needs, volumes agreeing."""
    return (settings.min_score - BASE - VOLUME_BONUS - TITLE * RATIO_SHARE) / (TITLE * WORDS_SHARE)


def rest_of_score(settings: Settings = DEFAULT) -> Column:
    """What featured columns x and y have of a score besides their titles' share."""
    agreed = F.coalesce(F.abs(F.col("x.volume") - F.col("y.volume")) <= settings.volume_tolerance_ml, F.lit(False))
    return BASE + MODEL * X.overlap(F.col("x.models"), F.col("y.models")) + F.when(agreed, VOLUME_BONUS).otherwise(0.0) + F.when(F.arrays_overlap("x.models", "y.models"), MODEL_BONUS).otherwise(0.0)


def can_reach(settings: Settings = DEFAULT) -> Column:
    """Whether featured columns x and y can reach the score: no conflict of their titles, and a bound on the score, by
    common words (their hashes, which are faster to compare and never share fewer), and where these suffice by letters."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    agree = F.coalesce(F.abs(x("volume") - y("volume")) <= settings.volume_tolerance_ml, F.lit(True))
    shared = F.size(F.array_intersect(x("hashes"), y("hashes")))
    most_common = F.when(shared == 0, 0.0).otherwise(shared / (F.size(x("hashes")) + F.size(y("hashes")) - shared))
    enough = lambda ratio: rest_of_score(settings) + TITLE * (RATIO_SHARE * ratio + WORDS_SHARE * most_common) >= settings.min_score - 1e-6
    # branches, since what two conjuncts share would be computed first, for all that meet
    apart = X.disjoint(x("colours"), y("colours")) | X.disjoint(x("models"), y("models"))
    return F.when(~agree, False).when(~enough(F.lit(1.0)), False).when(apart, False).otherwise(enough(most_ratio(x("letters"), y("letters"))))


def title_pairs(branded: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``(a, b)``, a < b: every pair of offers of one brand that can reach the score by their titles, found by equal keys only.

    Keys: brand and a model code; brand and one of the title's rarest words, as many that two titles with the words in
    common that the score asks for must meet in one (no pair without a common code passes with fewer). Where the score
    asks for no common words, the brand alone. What can't reach the score is dropped where it meets, so what is
    shuffled from then on grows with pairs that nearly match, not with all that share a key.

    ``branded``: (offer_id, merchant_id, brand_key, coded), with what ``can_reach`` asks for; an offer may come once for
    each of its brands. ``coded``: whether it has a valid GTIN; two valid GTINs match by their own key or not at all.
    """
    least = least_jaccard(settings)
    own = ["offer_id", "brand_key"]
    if least > 0:
        models = branded.select(*own, F.explode("models").alias("m")).select(*own, F.concat_ws(":", F.lit("m"), "brand_key", "m").alias("key"))
        words = branded.select(*own, F.size("words").alias("n"), F.explode("words").alias("w"))
        often = words.groupBy("brand_key", "w").agg(F.count(F.lit(1)).alias("often"))
        rare = words.join(often, ["brand_key", "w"]).withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy("often", "w")))
        rare = rare.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * min(1.0, least) - 1e-9) + 1)
        keys = models.unionByName(rare.select(*own, F.concat_ws(":", F.lit("w"), "brand_key", "w").alias("key")))
    else:
        keys = branded.select(*own, F.concat(F.lit("b:"), "brand_key").alias("key"))
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    keyed = keys.join(branded.select(*own, "merchant_id", "coded", F.struct("volume", "colours", "models", hashes, "letters").alias("look")), own)
    side = lambda rows, i, look: rows.select("key", F.col("offer_id").alias(i), F.col("merchant_id").alias(f"{i}m"), F.col("look").alias(look))
    # pairs take time by the square of a key's rows, not by bytes, so tasks are not put together
    parts = max(200, int(branded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bare, coded = keyed.where("not coded").repartition(parts, "key"), keyed.where("coded").repartition(parts, "key")
    met = side(bare, "a", "x").join(side(bare, "b", "y"), "key").where("a < b and am <> bm").where(can_reach(settings)).select("a", "b")
    mixed = side(bare, "a", "x").join(side(coded, "b", "y"), "key").where("a <> b and am <> bm").where(can_reach(settings))
    return met.unionAll(mixed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def candidate_pairs(featured: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``(a, b)``, a < b: every pair that can reach the score, found by equal keys only: a valid GTIN, or those of
    ``title_pairs``."""
    coded = featured.where("valid_gtin is not null")
    side = lambda x: coded.select("valid_gtin", F.col("offer_id").alias(x), F.col("merchant_id").alias(f"{x}m"))
    same = side("a").join(side("b"), "valid_gtin").where("a < b and am <> bm").select("a", "b")
    branded = featured.where("brand_key <> ''").withColumns({"coded": F.col("valid_gtin").isNotNull(), "letters": letter_counts(F.col("norm"))})
    return same.unionAll(title_pairs(branded, settings)).distinct()


def conflict(a: str, b: str, settings: Settings = DEFAULT) -> Column:
    """The first reason why two featured rows can't match, or null; and gtin for equal valid GTINs."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (
        F.when(x("merchant_id") == y("merchant_id"), "same-merchant")
        .when(x("valid_gtin") == y("valid_gtin"), "gtin").when(x("valid_gtin").isNotNull() & y("valid_gtin").isNotNull(), "gtin-conflict")
        .when((x("brand_key") == "") | (y("brand_key") == "") | (x("brand_key") != y("brand_key")), "brand")
        .when(F.abs(x("volume") - y("volume")) > settings.volume_tolerance_ml, "volume-conflict")
        .when(X.disjoint(x("colours"), y("colours")), "color-conflict").when(X.disjoint(x("models"), y("models")), "model-conflict")
    )


def scored_pairs(featured: DataFrame, pairs: DataFrame, settings: Settings = DEFAULT, bounded: bool = True) -> DataFrame:
    """``(a, b, score, reason)`` of each pair. ``bounded``: pairs whose bound is under the threshold are
    dropped before texts are compared, conflicts with them; what is left may still be under it."""
    f = featured.select("offer_id", "merchant_id", "valid_gtin", "brand_key", "volume", "colours", "models", "words", "norm", letter_counts(F.col("norm")).alias("letters"))
    rows = pairs.join(f.select(F.col("offer_id").alias("a"), F.struct("*").alias("x")), "a").join(f.select(F.col("offer_id").alias("b"), F.struct("*").alias("y")), "b")
    rows = rows.withColumn("why", conflict("x", "y", settings))
    rows = rows.withColumn("rest", rest_of_score(settings)).withColumn("jac", X.jaccard(F.col("x.words"), F.col("y.words")))
    open_ = F.col("why").isNull()
    if bounded:
        most = most_ratio(F.col("x.letters"), F.col("y.letters"))
        rows = rows.where((F.col("why") == "gtin") | (open_ & (F.col("rest") + TITLE * (RATIO_SHARE * most + WORDS_SHARE * F.col("jac")) >= settings.min_score - 1e-6)))
    compared = rows.where(open_).withColumn("ratio", text_ratio("x.norm", "y.norm"))
    compared = compared.select("a", "b", F.least(F.lit(MOST), F.col("rest") + TITLE * (RATIO_SHARE * F.col("ratio") + WORDS_SHARE * F.col("jac"))).alias("score"), F.lit("heuristic").alias("reason"))
    settled = rows.where(~open_).select("a", "b", F.when(F.col("why") == "gtin", 100.0).otherwise(0.0).alias("score"), F.col("why").alias("reason"))
    return compared.unionByName(settled)


#: What the score of two titles of one brand depends on, besides which offer id is smaller; and what a score depends on,
#: besides that and merchants.
TITLED = ("norm", "words", "volume", "colours", "models")
MATCHED = (*TITLED, "brand_key", "valid_gtin")


def kind_edges(rows: DataFrame, settings: Settings = DEFAULT, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Offers by kind, ``(offer_id, merchant_id, kind, own)``, and edges of kinds, ``(ka, kb, score, reason)``.

    Offers that are equal in MATCHED are one kind, which has a number; ``own`` is the GTIN that makes kinds one class, or the
    kind. Kinds are edges in both orders, since the text ratio has a first text, and each with itself: two offers of
    different merchants, the one of kind ka with the smaller id, are an edge where their kinds are. So the table grows
    with kinds, not with pairs of offers; ``offer_edges`` has these. Kinds that are equal in TITLED have one text, and
    texts are paired and scored once, for all brands and GTINs they come with; only those that reach the score are
    joined with their kinds. ``named``: the stored ``listings`` of the rows.
    """
    if named is None:
        named = materialize(listings(rows, settings), "listings")
    digest = lambda columns: F.sha2(F.to_json(F.struct(*columns)), 256)
    kinds = named.select(digest(MATCHED).alias("look"), digest(TITLED).alias("title_look"), *MATCHED).dropDuplicates(["look"])
    kinds = materialize(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    numbered = named.withColumn("look", digest(MATCHED)).join(kinds.select("look", "kind"), "look")
    own = F.coalesce(F.concat(F.lit("gtin:"), "valid_gtin"), F.col("kind").cast("string"))
    of = _of_listing(rows.select("offer_id", "merchant_id", *LISTING), numbered.select(*LISTING, "kind", own.alias("own")))
    of = materialize(of.select("offer_id", "merchant_id", "kind", "own"), "kinds-of-offers")
    texts = kinds.select("title_look", *TITLED).dropDuplicates(["title_look"])
    texts = materialize(texts.withColumns({"offer_id": F.monotonically_increasing_id(), "letters": letter_counts(F.col("norm"))}), "texts")
    branded = kinds.where("brand_key <> ''").join(texts.select("title_look", F.col("offer_id").alias("text")), "title_look")
    branded = materialize(branded.select("kind", "text", "brand_key", F.col("valid_gtin").isNotNull().alias("coded")), "branded-kinds")
    # a text whose kinds of a brand all have a GTIN
    offered = branded.groupBy(F.col("text").alias("offer_id"), "brand_key").agg(F.bool_and("coded").alias("coded")).join(texts, "offer_id")
    pairs = materialize(title_pairs(offered.withColumn("merchant_id", F.col("offer_id")), settings), "text-pairs")
    same = texts.select(F.col("offer_id").alias("a"), F.col("offer_id").alias("b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    # texts have no merchant, so that one can match itself, and the brand is one
    none = F.lit(None).cast("string")
    alone = texts.withColumns({"merchant_id": none, "valid_gtin": none, "brand_key": F.lit("one")})
    near = materialize(scored_pairs(alone, pairs, settings).where(F.col("score") >= settings.min_score), "text-edges")
    side = lambda t, k, c: branded.select(F.col("text").alias(t), "brand_key", F.col("kind").alias(k), F.col("coded").alias(c))
    titled = near.join(side("a", "ka", "ca"), "a").join(side("b", "kb", "cb"), ["b", "brand_key"]).where("not (ca and cb)").select("ka", "kb", "score", "reason")
    coded = kinds.where("valid_gtin is not null")
    equal = coded.select("valid_gtin", F.col("kind").alias("ka")).join(coded.select("valid_gtin", F.col("kind").alias("kb")), "valid_gtin")
    equal = equal.select("ka", "kb", F.lit(100.0).alias("score"), F.lit("gtin").alias("reason")).where(F.col("score") >= settings.min_score)
    return of, materialize(titled.unionByName(equal), "kind-edges")


def offer_edges(of: DataFrame, scored: DataFrame, part: Column | None = None) -> DataFrame:
    """``(a, b, score, reason)``: the pairs of offers behind edges of kinds, as many as there are.

    ``part``: a column of ``of``; pairs are made inside its values only, of which each is joined by its kinds first."""
    of = of.withColumn("part", F.lit(0) if part is None else part)
    left = of.select("part", F.col("kind").alias("ka"), F.col("offer_id").alias("a"), F.col("merchant_id").alias("am"))
    right = of.select("part", F.col("kind").alias("kb"), F.col("offer_id").alias("b"), F.col("merchant_id").alias("bm"))
    if part is None:
        met = scored.join(left.drop("part"), "ka").join(right.drop("part"), "kb")
    else:
        kinds = of.select("part", "kind").distinct()
        inside = kinds.select("part", F.col("kind").alias("ka")).join(kinds.select("part", F.col("kind").alias("kb")), "part").join(scored, ["ka", "kb"])
        met = inside.join(left, ["part", "ka"]).join(right, ["part", "kb"])
    return met.where("a < b and am <> bm").select("a", "b", "score", "reason")


def match_edges(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``(a, b, score, reason)``: the pairs of offers that reach the score."""
    return offer_edges(*kind_edges(rows, settings))


def match_classes(of: DataFrame, scored: DataFrame) -> DataFrame:
    """``(row, a, b, merchant_id, score, reason)``: all edges of offers, by kinds, each named after its first offer.

    A ``member`` row says that offer b, of a merchant, is of kind a. An ``edge`` row says that offers of kinds a and b, of
    different merchants and the one of kind a with the smaller id, are an edge of this score; so both orders have a row
    of their own, and a kind is an edge of itself where its offers are. ``offer_edges`` of that is ``match_edges``."""
    first = of.groupBy("kind").agg(F.min("offer_id").alias("first"))
    none = F.lit(None).cast("string")
    members = of.join(first, "kind").select(F.lit("member").alias("row"), F.col("first").alias("a"), F.col("offer_id").alias("b"), "merchant_id", F.lit(None).cast("double").alias("score"), none.alias("reason"))
    edges = scored.join(first.select(F.col("kind").alias("ka"), F.col("first").alias("a")), "ka").join(first.select(F.col("kind").alias("kb"), F.col("first").alias("b")), "kb")
    return members.unionByName(edges.select(F.lit("edge").alias("row"), "a", "b", none.alias("merchant_id"), "score", "reason"))


def _groups(labels: DataFrame) -> DataFrame:
    """``(group_id, slot, offer_id)`` of labels with two offers or more; a group is named after its first offer."""
    facts = labels.groupBy("label").agg(F.min("offer_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return labels.join(facts, "label").select("group_id", F.col("label").alias("slot"), "offer_id")


def cluster(edges: DataFrame) -> DataFrame:
    """``(group_id, slot, offer_id)`` for groups of two offers or more, by edges of offers.

    Greedy complete linkage: edges by falling score, then ids; two groups merge if each pair between them is an edge, so
    that no merchant comes twice. The slot is the first member of the group that the merged group stands in for.
    """
    return _groups(complete_linkage(edges.select(F.col("a").alias("g"), F.col("b").alias("h"), "score", "a", "b")).withColumnsRenamed({"node": "offer_id"}))


def cluster_kinds(of: DataFrame, scored: DataFrame, block: int = BLOCK, work: int = 20_000_000) -> DataFrame:
    """``cluster`` of all edges of offers, without making them.

    Kinds with edges make components. A task takes one that has ``block`` offers and edges of kinds at most, as it is
    (``linked_by_kinds``); larger ones, and those where one merchant has so many offers that this would take more than
    ``work`` steps, go on as edges of offers, by ``_cluster_in_rounds``.
    """
    linked = connected_components(scored.where("ka <> kb").select("ka", "kb"), "ka", "kb").select(F.col("node").alias("kind"), "component")
    linked = materialize(of.select("kind").distinct().join(linked, "kind", "left").select("kind", F.coalesce("component", "kind").alias("component")), "kind-components")
    placed = materialize(of.where("merchant_id is not null").join(linked, "kind"), "placed-offers")
    edges = scored.join(linked.withColumnRenamed("kind", "ka"), "ka")
    per = placed.groupBy("component", "merchant_id").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    per = per.join(edges.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component")
    per = materialize(per.select("component", ((F.greatest("n", "m") <= block) & (F.col("n") * F.col("most") <= work)).alias("small")), "component-sizes")
    small = per.where("small").select("component")

    def link(offers: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        rows = linked_by_kinds(zip(offers["offer_id"], offers["merchant_id"], offers["kind"]), zip(between["ka"], between["kb"], between["score"]))
        return pd.DataFrame(rows, columns=["offer_id", "label"], dtype=object)

    by = lambda rows, *c: rows.join(small, "component").select("component", *c).groupBy("component")
    labels = by(placed, "offer_id", "merchant_id", "kind").cogroup(by(edges, "ka", "kb", "score")).applyInPandas(link, "offer_id string, label string")
    found = _groups(materialize(labels, "labels"))
    large = per.where("not small").select("component")
    if large.isEmpty():
        return found
    return found.unionByName(_cluster_in_rounds(placed.join(large, "component", "left_semi").drop("component"), edges.join(large, "component", "left_semi").drop("component")))


def _cluster_in_rounds(of: DataFrame, scored: DataFrame) -> DataFrame:
    """``cluster`` of all edges of offers, without making those inside a class.

    A class is what has one valid GTIN or, without one, one kind; its offers are edges of each other, by one score. Where no
    edge that leaves the class has that score, these edges come first, and what they make is known: the n-th offers of
    its merchants, in order of ids, are a group. Only edges between such groups go on. Other classes (scores at the
    common upper limit) are taken offer by offer.
    """
    owns = of.select("kind", "own").distinct()
    sides = scored.join(owns.select(F.col("kind").alias("ka"), F.col("own").alias("oa")), "ka").join(owns.select(F.col("kind").alias("kb"), F.col("own").alias("ob")), "kb")
    sides = materialize(sides, "class-edges")
    inside = sides.where("oa = ob").groupBy(F.col("oa").alias("own")).agg(F.min("score").alias("inner"))
    leaving = sides.where("oa <> ob")
    outer = leaving.select(F.col("oa").alias("own"), "score").unionAll(leaving.select("ob", "score")).groupBy("own").agg(F.max("score").alias("outer"))
    classes = inside.join(outer, "own", "left").select("own", F.coalesce(F.col("outer") >= F.col("inner"), F.lit(False)).alias("tied"))
    nth = F.row_number().over(Window.partitionBy("own", "merchant_id").orderBy("offer_id"))
    members = of.join(classes, "own").withColumn("nth", F.when(~F.col("tied"), nth))
    first = F.min("offer_id").over(Window.partitionBy("own", "nth"))
    members = materialize(members.select("offer_id", "merchant_id", "kind", "tied", F.when(F.col("tied"), F.col("offer_id")).otherwise(first).alias("atom")), "atoms")

    open_ = sides.where("oa <> ob").unionByName(sides.where("oa = ob").join(classes.where("tied").select(F.col("own").alias("oa")), "oa", "left_semi"))
    left = members.select(F.col("kind").alias("ka"), F.col("offer_id").alias("a"), F.col("merchant_id").alias("am"), F.col("atom").alias("g"))
    right = members.select(F.col("kind").alias("kb"), F.col("offer_id").alias("b"), F.col("merchant_id").alias("bm"), F.col("atom").alias("h"))
    met = open_.join(left, "ka").join(right, "kb").where("a < b and am <> bm and g <> h")
    best = F.struct((-F.col("score")).alias("down"), "a", "b", "g", "h")
    met = met.groupBy(F.least("g", "h").alias("x"), F.greatest("g", "h").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    sizes = members.groupBy("atom").agg(F.count(F.lit(1)).alias("size"))
    met = met.join(sizes.select(F.col("atom").alias("x"), F.col("size").alias("nx")), "x").join(sizes.select(F.col("atom").alias("y"), F.col("size").alias("ny")), "y").where("n = nx * ny")
    linked = complete_linkage(materialize(met.select("best.g", "best.h", (-F.col("best.down")).alias("score"), "best.a", "best.b"), "atom-edges"))
    return _groups(members.join(linked.withColumnRenamed("node", "atom"), "atom", "left").select("offer_id", F.coalesce("label", "atom").alias("label")))


def group_facts(groups: DataFrame, of: DataFrame, scored: DataFrame) -> DataFrame:
    """For each group its size, best score and reasons, from the edges inside it. A group has one offer a merchant."""
    own = groups.join(of.select("offer_id", "kind"), "offer_id").groupBy("group_id", "kind").agg(F.min("offer_id").alias("low"), F.max("offer_id").alias("high"))
    a, b = own.select("group_id", F.col("kind").alias("ka"), "low"), own.select("group_id", F.col("kind").alias("kb"), "high")
    # an offer of kind ka is before one of kind kb
    inside = a.join(b, "group_id").where("low < high").join(scored, ["ka", "kb"])
    facts = inside.groupBy("group_id").agg(F.max("score").alias("best_score"), F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reasons"))
    return groups.groupBy("group_id", "slot").agg(F.count(F.lit(1)).alias("size")).join(facts, "group_id")


def resolve(rows: DataFrame, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Features, kinds, groups and their facts of offer rows. What is stored is by listing, kind or group, and the kind
    of each offer; ``featured``, and ``edges``, those of offers, are made when they are read."""
    named = materialize(listings(rows, settings), "listings")
    of, scored = kind_edges(rows, settings, named)
    groups = materialize(cluster_kinds(of, scored), "groups")
    return {"featured": _of_listing(rows, named), "kinds": of, "kind_edges": scored, "edges": offer_edges(of, scored), "groups": groups, "facts": materialize(group_facts(groups, of, scored), "facts")}


def group_report(groups: DataFrame, facts: DataFrame, rows: DataFrame, limit: int = DEFAULT.report_groups) -> DataFrame:
    """The best groups' members by price and merchant, the cheapest one marked, with the spread of prices."""
    top = facts.orderBy(F.desc("best_score"), F.desc("size"), "slot").limit(limit)
    members = groups.select("group_id", "offer_id").join(top, "group_id").join(rows, "offer_id")
    own = Window.partitionBy("group_id")
    members = members.withColumn("place", F.row_number().over(own.orderBy("price", "merchant", "offer_id"))).withColumn("spread", F.max("price").over(own) - F.min("price").over(own))
    return members.select("group_id", "best_score", "size", "reasons", "place", (F.col("place") == 1).alias("cheapest"), "merchant", "price", "currency", "title", "spread")
