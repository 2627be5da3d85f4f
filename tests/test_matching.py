import itertools
import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.config import DEFAULT, Settings
from bazaarlens.operators import canonical, matching

ROWS = "offer_id string, merchant_id string, product_id string, brand string, title string, gtin string, merchant string, price double, currency string"


def rows(spark, cases):
    """(merchant, brand, title, gtin) each."""
    return spark.createDataFrame([(f"o{k:03}", m, f"p{k}", b, t, g, m, 10.0 + k, "TRY") for k, (m, b, t, g) in enumerate(cases)], ROWS)


def scores(spark, cases, bounded=False):
    featured = matching.with_features(rows(spark, cases)).cache()
    ids = [r.offer_id for r in featured.select("offer_id").collect()]
    pairs = spark.createDataFrame([p for p in itertools.combinations(sorted(ids), 2)], "a string, b string")
    return {(r.a, r.b): (r.score, r.reason) for r in matching.scored_pairs(featured, pairs, bounded=bounded).collect()}


@pytest.mark.parametrize(
    "one,two,want",
    [
        (("m", "B", "x", None), ("m", "B", "x", None), (0, "same-merchant")),
        (("m", "A", "x", "4006381333931"), ("n", "B", "y", "4006381333931"), (100, "gtin")),
        (("m", "B", "x", "4006381333931"), ("n", "B", "x", "12345670"), (0, "gtin-conflict")),
        (("m", None, "x", None), ("n", "B", "x", None), (0, "brand")),
        (("m", "B", "icon 500 ml", None), ("n", "B", "icon 506 ml", None), (0, "volume-conflict")),
        (("m", "B", "icon pink", None), ("n", "B", "icon blue", None), (0, "color-conflict")),
        (("m", "B", "icon AB123", None), ("n", "B", "icon CD456", None), (0, "model-conflict")),
        (("m", "B", "icon flask", None), ("n", "b", "icon flask", None), (82, "heuristic")),
        (("m", "B", "icon 500 ml", None), ("n", "B", "icon 500 ml", None), (88, "heuristic")),
        (("m", "B", "icon AB123 500 ml", None), ("n", "B", "icon AB123 500 ml", None), (99, "heuristic")),
        (("m", "B", "Termos Bardak", None), ("n", "B", "Termos Bardak", None), (63.3, "heuristic")),
    ],
)
def test_pair_scores(spark, one, two, want):
    score, reason = scores(spark, [one, two])["o000", "o001"]
    assert score == pytest.approx(want[0]) and reason == want[1]


def random_cases(seed, n=40):
    rnd = random.Random(seed)
    words = ["icon", "flask", "steel", "cup", "go", "pro", "max", "slim"]
    gtins = [None, None, None, "4006381333931", "12345670"]
    return [(rnd.choice("mnop"), rnd.choice(["B", "C", None]), " ".join(rnd.sample(words, rnd.randint(2, 4)) + rnd.choice([[], ["500 ml"], ["AB123"], ["pink"], ["blue", "1 l"]])), rnd.choice(gtins)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_keys_and_bounds_lose_no_edge(spark, seed):
    cases = random_cases(seed)
    want = {k: v for k, v in scores(spark, cases).items() if v[0] >= DEFAULT.min_score}
    got = {(r.a, r.b): (r.score, r.reason) for r in matching.match_edges(matching.with_features(rows(spark, cases))).collect()}
    assert got == want and want


def test_low_threshold_uses_brands(spark):
    settings = Settings(min_score=60)
    featured = matching.with_features(rows(spark, random_cases(9, 16)), settings)
    pairs = matching.candidate_pairs(featured, settings).count()
    assert matching.least_jaccard(settings) < 0 and pairs > 0
    with pytest.raises(ValueError):
        Settings(min_score=0)


def test_pairs_that_cant_reach_the_score_are_not_made(spark):
    """Titles that share one word of two and a volume, in other letters: 900 pairs meet by that word, none can be an edge."""
    titles = [f"{x * 7} {y * 7} 500 ml" for x in "abcdefghij" for y in "qrstuvwxyz"]
    featured = matching.with_features(rows(spark, [(str(k), "B", t, None) for k, t in enumerate(titles)]))
    assert matching.candidate_pairs(featured).count() == 0
    one_more = matching.with_features(rows(spark, [(str(k), "B", t, None) for k, t in enumerate([*titles, "aaaaaaa qqqqqqq 500 ml classic"])]))
    assert [tuple(r) for r in matching.candidate_pairs(one_more).collect()] == [("o000", "o100")]


def test_texts_are_compared_once_for_all_brands(spark, monkeypatch):
    """The same titles of 12 brands, with and without a GTIN: as many texts are compared as for one brand."""
    compared, scored_pairs = [], matching.scored_pairs
    monkeypatch.setattr(matching, "scored_pairs", lambda featured, pairs, *a, **k: (compared.append(pairs.count()), scored_pairs(featured, pairs, *a, **k))[1])
    titles = [f"icon flask steel {w} 500 ml" for w in ("cup", "cap", "cop", "cut")]
    gtins = ["4006381333931", "12345670", None, None]
    counts = []
    for brands in (1, 12):
        cases = [(m, f"B{b}", t, g if b == 0 and m == "m" else None) for b in range(brands) for m in "mn" for t, g in zip(titles, gtins)]
        counts.append(matching.kind_edges(rows(spark, cases))[1].groupBy("reason").count().collect())
    one, many = ({r.reason: r["count"] for r in c} for c in counts)
    assert compared[0] == compared[1] == 16
    # six kinds of the first brand, two of them with a GTIN and so only an edge of themselves and of those without; four of each other brand
    assert one == {"gtin": 2, "heuristic": 16 + 2 * 2 * 4} and many == {"gtin": 2, "heuristic": one["heuristic"] + 11 * 16}


def merge(edges, merchant):
    """One pass over all edges by falling score, then ids: two groups merge if no merchant comes twice and each pair
    between them is an edge. (members, slot): the slot is the first member of the group of the edge's first end."""
    linked = {frozenset(e[:2]) for e in edges}
    group = {i: [i] for i in merchant}
    for a, b, *_ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        one, two = group[a], group[b]
        if one is two or {merchant[i] for i in one} & {merchant[i] for i in two}:
            continue
        if all(frozenset((i, j)) in linked for i in one for j in two):
            for i in two:
                group[i] = one
            one.extend(two)
    return [(sorted(m), m[0]) for m in {id(m): m for m in group.values()}.values()]


def clusters(edges, merchant):
    return sorted(sorted(m) for m, _ in merge(edges, merchant) if len(m) > 1)


def of_groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.group_id, r.slot), []).append(r.offer_id)
    return sorted((sorted(m), slot) for (_, slot), m in out.items())


def random_edges(seed, n=60, shops=7, scores=(80, 85, 90)):
    rnd = random.Random(seed)
    merchant = {f"o{k:03}": str(rnd.randrange(shops)) for k in range(n)}
    return [(a, b, float(rnd.choice(scores))) for a, b in itertools.combinations(sorted(merchant), 2) if merchant[a] != merchant[b] and rnd.random() < rnd.choice([0.05, 0.5])], merchant


@pytest.mark.parametrize(("seed", "block"), [(1, 200_000), (2, 60), (3, 20), (4, 7)])
def test_rounds_are_one_pass_in_order(spark, monkeypatch, seed, block):
    """Groups and slots of random graphs, in blocks down to a few edges."""
    from bazaarlens.plans import linkage

    edges, merchant = random_edges(seed)
    monkeypatch.setattr(linkage.complete_linkage, "__defaults__", (block,))
    got = of_groups(matching.cluster(spark.createDataFrame(edges, "a string, b string, score double")))
    assert got == sorted((m, s) for m, s in merge(edges, merchant) if len(m) > 1) and got


def test_blocks_decide_only_what_is_sure():
    """A block of some nodes of a random graph merges no pair that one pass over the whole graph wouldn't."""
    from bazaarlens.plans.linkage import merged_in_order

    for seed in range(60):
        rnd = random.Random(seed)
        edges, merchant = random_edges(seed, 24, 6)
        part = set(rnd.sample(sorted(merchant), rnd.choice([8, 16, 24])))
        rows = [(x, y, x == a, s, a, b) for a, b, s in edges for x, y in ((a, b), (b, a)) if x in part]
        whole = {i: slot for m, slot in merge(edges, merchant) for i in m}
        found = merged_in_order(rows)
        for old, new in found.items():
            assert whole[old] == whole[new]
        if len(part) == 24:
            assert {i: found.get(i, i) for i in merchant} == whole


def test_a_chain_of_100000_offers(spark):
    """Each edge waits for the one before it, over the bounds of blocks."""
    n = 100_000
    edges = spark.range(n - 1).select(F.format_string("o%06d", "id").alias("a"), F.format_string("o%06d", F.col("id") + 1).alias("b"), F.lit(90.0).alias("score"))
    found = matching.cluster(edges)
    assert found.count() == n and found.select("group_id").distinct().count() == n // 2
    assert found.where("cast(substr(offer_id, 2) as int) div 2 <> cast(substr(group_id, 2) as int) div 2").count() == 0


def test_letter_counts_bound_the_text_ratio(spark):
    rnd = random.Random(3)
    made = ["".join(rnd.choice("abcé ız09") for _ in range(rnd.randint(0, 14))) for _ in range(200)]
    df = spark.createDataFrame(list(zip(made, made[::-1])), "x string, y string")
    rows = df.select(matching.text_ratio("x", "y").alias("ratio"), matching.most_ratio(matching.letter_counts(F.col("x")), matching.letter_counts(F.col("y"))).alias("most")).collect()
    assert all(r.ratio <= r.most + 1e-12 for r in rows) and sum(r.most < 0.5 for r in rows) > 20


def test_atoms_give_the_groups_of_all_edges(spark):
    """Classes, and those at the common upper limit, against one pass over the edges of offers."""
    for seed in (21, 22):
        cases = random_cases(seed, 60) + [(m, "B", f"icon flask steel AB123 500 ml {w}", None) for m in "mnopm" for w in ("cup", "cap")]
        rnd = random.Random(seed)
        rnd.shuffle(cases)
        found = matching.resolve(rows(spark, cases))
        merchant = {r.offer_id: r.merchant_id for r in found["featured"].collect()}
        edges = [(r.a, r.b, r.score) for r in found["edges"].collect()]
        assert of_groups(found["groups"]) == sorted((m, s) for m, s in merge(edges, merchant) if len(m) > 1)


def test_complete_linkage():
    shops = {"a": "1", "b": "2", "c": "3", "d": "4"}
    assert clusters([("a", "b", 95), ("b", "c", 90)], shops) == [["a", "b"]]
    assert clusters([("a", "b", 95), ("b", "c", 90), ("a", "c", 80)], shops) == [["a", "b", "c"]]
    full = [("a", "b", 95), ("c", "d", 94), ("b", "c", 93), ("a", "c", 80), ("b", "d", 80)]
    assert clusters([*full, ("a", "d", 80)], shops) == [["a", "b", "c", "d"]]
    assert clusters(full, shops) == [["a", "b"], ["c", "d"]]
    assert clusters([("a", "b", 95)], {"a": "1", "b": "1"}) == []


def test_clusters_keep_their_rules(spark):
    found = matching.resolve(rows(spark, random_cases(4, 60)))
    groups = {}
    for r in found["groups"].join(found["featured"], "offer_id").collect():
        groups.setdefault(r.group_id, []).append(r)
    edges = {(r.a, r.b): r.score for r in found["edges"].collect()}
    assert groups
    for members in groups.values():
        assert len({m.merchant_id for m in members}) == len(members)
        assert all(pair in edges for pair in itertools.combinations(sorted(m.offer_id for m in members), 2))
    facts = {r.group_id: r for r in found["facts"].collect()}
    for g, members in groups.items():
        ids = sorted(m.offer_id for m in members)
        assert facts[g].best_score == max(edges[p] for p in itertools.combinations(ids, 2)) and facts[g].size == len(ids)
    report = matching.group_report(found["groups"], found["facts"], found["featured"], 2).collect()
    assert len({r.group_id for r in report}) <= 2 and all(r.cheapest == (r.place == 1) for r in report)


def test_whole_is_clustered_as_by_one_task(spark):
    cases = random_cases(11, 50)
    found = matching.resolve(rows(spark, cases))
    merchant = {r.offer_id: r.merchant_id for r in found["featured"].collect()}
    want = clusters([(r.a, r.b, r.score) for r in found["edges"].collect()], merchant)
    got = {}
    for r in found["groups"].collect():
        got.setdefault(r.group_id, []).append(r.offer_id)
    assert sorted(map(sorted, got.values())) == want


def test_survivors(spark):
    members = [
        ("g", "1", "Long title X", "Stanley", None, 500, ["pink", "blue"]), ("g", "2", "X Fiyatları ve Özellikleri", "STANLEY", "12345670", None, ["blue"]), ("g", "3", "XY", "stanley-1913", "12345670", 500, []),
        ("h", "4", "", None, "12345670", 500, ["pink"]), ("h", "5", None, " ", "4006381333931", 505, ["blue"]),
    ]
    df = spark.createDataFrame(members, "group_id string, offer_id string, title string, brand string, valid_gtin string, volume int, colours array<string>")
    got = {r.group_id: r for r in canonical.survivors(df).collect()}
    assert tuple(got["g"]) == ("g", "Stanley", "X", "x", 500, "blue", "12345670")
    assert tuple(got["h"]) == ("h", None, "Eşleştirilmiş ürün", "eslestirilmis urun", None, None, None)


def test_groups_are_applied_in_order(spark):
    groups = spark.createDataFrame([("g1", "g1", "a"), ("g1", "g1", "b"), ("g2", "g2", "c"), ("g2", "g2", "d"), ("g3", "g3", "e"), ("g3", "g3", "f"), ("g4", "g4", "h"), ("g4", "g4", "i")], "group_id string, slot string, offer_id string")
    facts = spark.createDataFrame([("g1", "g1", 2, 90.0, "gtin"), ("g2", "g2", 2, 95.0, "gtin"), ("g3", "g3", 2, 80.0, "gtin"), ("g4", "g4", 2, 99.0, "gtin")], "group_id string, slot string, size long, best_score double, reasons string")
    offers = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p2"), ("d", "p3"), ("e", "p4"), ("f", "p5"), ("h", "p9"), ("i", "p8")], "offer_id string, product_id string")
    prior = spark.createDataFrame([("p9", "rejected")], "product_id string, status string")
    assert [r.group_id for r in canonical.applied_groups(groups, facts, offers, prior).collect()] == ["g2"]
    none = canonical.applied_groups(groups, facts.where("false"), offers, prior)
    assert none.count() == 0


@pytest.mark.parametrize("block", [200_000, 40, 6])
def test_choice_in_rounds(spark, block):
    """Groups that share products, against one pass in order."""
    from bazaarlens.plans.linkage import first_disjoint

    rnd = random.Random(block)
    groups = {f"g{k:03}": (float(rnd.randrange(5)), rnd.sample(range(90), rnd.choice([1, 2, 3]))) for k in range(120)}
    used, want = set(), []
    for name, (_, products) in sorted(groups.items(), key=lambda g: (-g[1][0], g[0])):
        if used.isdisjoint(products):
            used.update(products)
            want.append(name)
    claims = spark.createDataFrame([(n, str(p), s) for n, (s, products) in groups.items() for p in products], "name string, key string, score double")
    assert sorted(r.name for r in first_disjoint(claims, [-F.col("score"), F.col("name")], block).collect()) == sorted(want)


def test_a_contested_chain_of_100000_groups(spark):
    """Group k shares a product with the next one, and its score falls: every second one applies."""
    n = 100_000
    name = F.format_string("g%06d", "id")
    groups = spark.range(n).select(name.alias("group_id"), name.alias("slot"), F.explode(F.array((F.col("id") * 2).cast("string"), (F.col("id") * 2 + 1).cast("string"))).alias("offer_id"))
    facts = spark.range(n).select(name.alias("group_id"), name.alias("slot"), F.lit(2).cast("long").alias("size"), (100 - F.col("id") * 1e-5).alias("best_score"), F.lit("gtin").alias("reasons"))
    offers = spark.range(2 * n).select(F.col("id").cast("string").alias("offer_id"), F.floor((F.col("id") + 1) / 2).cast("string").alias("product_id"))
    prior = spark.createDataFrame([], "product_id string, status string")
    found = canonical.applied_groups(groups, facts, offers, prior)
    assert found.count() == n // 2 and found.where("cast(substr(group_id, 2) as int) % 2 = 1").count() == 0


def expanded(classes):
    """Edges of offers of the query's kinds and members."""
    rows = classes.collect()
    of = {}
    for r in rows:
        if r.row == "member":
            of.setdefault(r.a, []).append((r.b, r.merchant_id))
    return {(a, b): (r.score, r.reason) for r in rows if r.row == "edge" for a, am in of[r.a] for b, bm in of[r.b] if a < b and am != bm}


@pytest.mark.parametrize("seed", range(4))
def test_components_are_linked_without_their_edges(spark, seed):
    """Few titles with many copies, with and without GTINs, in one task and in rounds, against one pass over all edges."""
    rnd = random.Random(seed)
    titles = [f"icon flask steel {w} {v} ml" for w in ("cup", "cap", "cop") for v in (500, 504)] + ["icon flask go"]
    cases = [(rnd.choice("mnopqrs"), "B", rnd.choice(titles), rnd.choice([None, None, "4006381333931", "12345670"])) for _ in range(70)]
    of, scored = matching.kind_edges(rows(spark, cases))
    edges = [(r.a, r.b, r.score) for r in matching.offer_edges(of, scored).collect()]
    merchant = {r.offer_id: r.merchant_id for r in of.collect()}
    want = sorted((m, s) for m, s in merge(edges, merchant) if len(m) > 1)
    assert of_groups(matching.cluster_kinds(of, scored)) == want and len(want) > 3
    if seed == 0:
        assert of_groups(matching.cluster_kinds(of, scored, block=0)) == want


def test_many_copies_of_a_title_are_no_pairs():
    """20,000 offers of one title are 200 million edges of offers, but few steps."""
    from time import process_time

    from bazaarlens.plans.linkage import linked_by_kinds

    offers = [(f"{i:06}", i % 10_000, i % 7) for i in range(20_000)]
    began = process_time()
    labels = dict(linked_by_kinds(offers, [(x, y, 88.0) for x in range(7) for y in range(7)]))
    assert process_time() - began < 20 and set(labels.values()) == {"000000", "010000"}


def test_similar_titles_are_pairs_of_classes(spark, sf, tmp_path):
    """50 copies of each part add a row each, not a pair of all copies."""
    from bazaarlens import queries as Q

    part = spark.read.parquet(f"{sf}/part.parquet")
    part.crossJoin(spark.range(50)).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("id")).drop("id").write.parquet(f"file://{tmp_path}/part.parquet")
    one, many = ({(int(r.a), int(r.b)): r.jac for r in Q.QUERIES["jaccard_pairs"](spark, d).collect()} for d in (sf, f"file://{tmp_path}"))
    n = part.count()
    assert one.items() <= many.items() and len(many) == len(one) + 49 * n


def test_facts_without_pairs_of_members(spark):
    """A group of 20,000 offers has 200 million pairs."""
    groups = spark.range(20_000).select(F.lit("g").alias("group_id"), F.lit("g").alias("slot"), F.format_string("%06d", "id").alias("offer_id"))
    of = groups.select("offer_id", (F.col("offer_id").cast("long") % 3).alias("kind"))
    scored = spark.createDataFrame([(0, 0, 88.0, "heuristic"), (2, 1, 90.0, "gtin"), (2, 3, 99.0, "no")], "ka long, kb long, score double, reason string")
    assert tuple(matching.group_facts(groups, of, scored).select("size", "best_score", "reasons").first()) == (20_000, 90.0, "gtin,heuristic")


def test_queries_match_all_offers(spark, sf, tmp_path):
    """The three queries on a few parts, against all pairs of all their offers in stock."""
    from bazaarlens import queries as Q

    for t in ("part", "supplier", "lineitem"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        if t != "supplier":
            key = "p_partkey" if t == "part" else "l_partkey"
            df = df.where(f"{key} in (9, 10, 19, 29)" if t == "part" else f"{key} in (9, 10, 19, 29) and l_orderkey % 2 = 0")
        df.write.parquet(f"file://{tmp_path}/{t}.parquet")
    d = f"file://{tmp_path}"
    featured = matching.with_features(Q._all_offers(spark, d)).cache()
    own = {r.offer_id: r for r in featured.collect()}
    assert len(own) == spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag <> 'R'").count() > 4
    pairs = spark.createDataFrame(list(itertools.combinations(sorted(own), 2)), "a string, b string")
    want = {(r.a, r.b): (r.score, r.reason) for r in matching.scored_pairs(featured, pairs, bounded=False).collect() if r.score >= DEFAULT.min_score}
    assert expanded(Q.QUERIES["match_edges"](spark, d)) == want
    assert any(own[a].product_id == own[b].product_id for a, b in want)
    groups = {}
    for r in Q.QUERIES["match_groups"](spark, d).collect():
        groups.setdefault(r.group_id, []).append(r.offer_id)
    assert sorted(map(sorted, groups.values())) == clusters([(a, b, s) for (a, b), (s, _) in want.items()], {i: r.merchant_id for i, r in own.items()})
    assert {r.id for r in Q.QUERIES["canonical_survivors"](spark, d).collect()} <= {f"canonical-{g}" for g in groups}


def test_edges_of_a_whole_table_by_hand(spark, sf):
    """The registered query against all pairs of offers in stock, scored in plain Python."""
    from difflib import SequenceMatcher
    from itertools import combinations

    from bazaarlens import queries

    rows = matching.with_features(queries._all_offers(spark, sf)).select("offer_id", "merchant_id", *matching.MATCHED).collect()
    kinds: dict = {}
    for r in rows:
        kinds.setdefault((r.norm, r.brand_key, tuple(r.words), r.volume, tuple(r.colours), tuple(r.models), r.valid_gtin), []).append((r.offer_id, r.merchant_id))

    def score(x, y):
        norm, brand, words, volume, colours, models, gtin = zip(x, y)
        if all(gtin):
            return 100.0 if gtin[0] == gtin[1] else 0.0
        sure = all(v is not None for v in volume)
        if not all(brand) or brand[0] != brand[1] or (sure and abs(volume[0] - volume[1]) > 5):
            return 0.0
        for sets in (colours, models):
            if all(sets) and not set(sets[0]) & set(sets[1]):
                return 0.0
        shared, either = set(words[0]) & set(words[1]), set(words[0]) | set(words[1])
        codes = set(models[0]) & set(models[1])
        part = len(codes) / min(len(set(m)) for m in models) if all(models) else 0.0
        ratio = SequenceMatcher(None, norm[0], norm[1]).ratio()
        jac = len(shared) / len(either) if either else 0.0
        return min(99.0, 48 + 34 * (0.45 * ratio + 0.55 * jac) + 12 * part + (6 if sure else 0) + (5 if codes else 0))

    want = {}
    for x, y in [*((k, k) for k in kinds), *combinations(kinds, 2)]:
        pair = {one: score(*one) for one in ((x, y), (y, x))}
        if max(pair.values()) < 78:
            continue
        for a, am in kinds[x]:
            for b, bm in kinds[y]:
                if am != bm and (x != y or a < b):
                    found = pair[x, y] if a < b else pair[y, x]
                    if found >= 78:
                        want[min(a, b), max(a, b)] = round(found, 6)
    got = {pair: round(score, 6) for pair, (score, _) in expanded(queries.match_edges(spark, sf)).items()}
    assert got == want and len(got) > 1000
