import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarlens import schemas
from bazaarlens.config import DEFAULT
from bazaarlens.operators import deals, tables
from bazaarlens.plans import catalog
from bazaarlens.sources import adapters
from bazaarlens.sources.store import TableStore
from bazaarlens.streaming import prices

NOW = DEFAULT.as_of


@pytest.mark.parametrize(
    "current,rows,status,drop,verified",
    [
        (95, [], "insufficient_history", 0, False),
        (95, [(95, 0)], "insufficient_history", 0, False),
        (95, [(95, 0), (100, 5)], "price_drop", 5.0, True),
        (95, [(95, 0), (95, 5)], "no_observed_drop", 0, False),
        (95, [(95, 0), (96, 5)], "no_significant_drop", 1.0417, False),
        (95, [(95, 0), (100, 45)], "price_drop", 5.0, True),
        (95, [(95, 0), (100, 91)], "insufficient_history", 0, False),
        (100, [(100, 0), (90, 5)], "no_significant_drop", 0, False),
        (95, [(95, 0), (0, 3), (100, 5)], "price_drop", 5.0, True),
    ],
)
def test_history(spark, current, rows, status, drop, verified):
    cur = spark.createDataFrame([("o", float(current))], "offer_id string, current_price double")
    hist = spark.createDataFrame([("o", float(p), True, NOW - timedelta(days=d)) for p, d in rows], schemas.PRICE_HISTORY)
    r = deals.history_analysis(cur, hist).first()
    assert (r.history_status, r.verified) == (status, verified) and r.history_drop_percent == pytest.approx(drop, abs=1e-3)


def shop(spark, prices_by_product):
    """Tables with a product per key and an offer per price, each of another merchant."""
    can = spark.createDataFrame([(k, "B", f"title {k}", "", None, None, None, k != "off", None) for k in prices_by_product], schemas.CANONICAL)
    match = spark.createDataFrame([(f"m{k}", k, f"p{k}", 99.0, "gtin", "approved", None) for k in prices_by_product], schemas.MATCHES)
    var = spark.createDataFrame([(f"v{k}", f"p{k}", None, k, None, True) for k in prices_by_product], schemas.VARIANTS)
    off = spark.createDataFrame([(f"o{k}{j}", f"v{k}", f"s{j}", k, f"u{k}{j}", p, "TRY", True, None, NOW, None) for k, ps in prices_by_product.items() for j, p in enumerate(ps)], schemas.OFFERS)
    return can, match, var, off


def test_gap_is_inclusive(spark):
    can, match, var, off = shop(spark, {"a": [85.0, 100.0], "b": [85.01, 100.0], "c": [5.0], "d": [], "e": [None, 0.0, 3.0]})
    out = {r.canonical_product_id: r.outcome for r in deals.classify(deals.ranked_gaps(deals.offer_groups(can, match, var, off)), can).collect()}
    assert out == {"a": "candidate", "b": "normal", "c": "insufficient", "d": "insufficient", "e": "insufficient"}


def old_deal(product, status):
    early = NOW - timedelta(days=9)
    return (f"deal-{product}", product, "x", "y", 1.0, "z", "w", 2.0, 50.0, 15.0, status, early, early, True, early, "price_drop", 7, 1.0, 1.0, 1.0, 9.0, 5.0)


def test_life_cycle(spark):
    data = {f"{o}-{s}": p for s in ("none", "candidate", "expired") for o, p in {"cand": [50.0, 100.0], "norm": [99.0, 100.0], "few": [9.0]}.items()}
    can, match, var, off = shop(spark, data | {"off": [1.0, 9.0]})
    old = spark.createDataFrame([old_deal(k, k.split("-")[1]) for k in data if not k.endswith("none")] + [old_deal("off", "candidate")], schemas.DEALS)
    hist = spark.createDataFrame([("ocand-none0", p, True, NOW - timedelta(days=d)) for p, d in ((50.0, 0), (60.0, 4))], schemas.PRICE_HISTORY)
    new, outcomes, analysed = deals.run_deals(can, match, var, off, hist, old)
    got = {r.canonical_product_id: r for r in new.collect()}
    assert set(got) == set(data) - {"norm-none", "few-none"} | {"off"}
    early = NOW - timedelta(days=9)
    assert got["cand-none"].detected_at == NOW and got["cand-none"].verified and got["cand-none"].verified_at == NOW and got["cand-none"].gap_percent == 50.0
    for s in ("candidate", "expired"):
        assert got[f"cand-{s}"].status == "candidate" and got[f"cand-{s}"].detected_at == early and not got[f"cand-{s}"].verified and got[f"cand-{s}"].history_status == "insufficient_history"
        assert got[f"norm-{s}"].status == "expired" and got[f"norm-{s}"].cheapest_price == 99.0 and got[f"norm-{s}"].history_points == 7 and got[f"norm-{s}"].verified_at is None
    assert got["few-candidate"].status == "expired" and got["few-candidate"].cheapest_price == 1.0 and got["few-candidate"].updated_at == NOW
    assert tuple(got["few-expired"]) == tuple(old.where("canonical_product_id = 'few-expired'").first()) and got["off"].status == "candidate" and got["off"].updated_at == early
    assert tuple(deals.counters(outcomes, analysed).first()) == (3, 1, 3, 3)


def test_feed(spark):
    rows = [old_deal(k, s)[:8] + (g,) + old_deal(k, s)[9:] for k, s, g in (("a", "candidate", 20.0), ("b", "candidate", 40.0), ("c", "expired", 90.0), ("d", "candidate", None))]
    can, _, _, off = shop(spark, {"a": [1.0], "b": [1.0]})
    shops = spark.createDataFrame([("y", "", "slug-y", None, True)], schemas.MERCHANTS)
    feed = deals.deal_feed(spark.createDataFrame(rows, schemas.DEALS), can, off, shops, limit=2)
    got = feed.collect()
    assert {r.id for r in got} == {"deal-d", "deal-b"} and {r.merchant for r in got} == {"slug-y"} and {r.competitor_merchant for r in got} == {"Rakip mağaza"} and {r.product_url for r in got} == {"#"}
    assert {r.title for r in got} == {"Ürün", "title b"}
    shown = {r.id: r for r in deals.presented(feed).collect()}
    assert shown["deal-b"].gap == "%40" and shown["deal-b"].drop == "%9.0" and shown["deal-b"].price == "₺1,00"
    assert tuple(deals.feed_counters(feed).first()) == (2, 2)


def test_labels(spark):
    df = spark.createDataFrame([("price_drop", 5.0, 2), ("insufficient_history", 0.0, 1), ("no_observed_drop", 0.0, 2), ("x", 1.5, 3)], "s string, d double, n int")
    got = [r[0] for r in df.select(deals.history_label(F.col("s"), F.col("d"), F.col("n"))).collect()]
    assert got == ["DOĞRULANDI (%5.00 geçmiş fiyat düşüşü)", "YETERSİZ VERİ (1 geçmiş kayıt)", "FİYAT DÜŞÜŞÜ HENÜZ GÖRÜLMEDİ", "ANLAMLI DÜŞÜŞ YOK (%1.50)"]


def test_labels_round_by_the_exact_value(spark):
    rnd = random.Random(5)
    made = [0.0, 0.005, 0.015, 0.125, 0.375, 1.005, 1.015, 2.675, 12.125, 12.375, 99.995, 99.999, 100.0, 0.0049999999, 1e-300, 8.345, 4398046511103.125]
    made += [rnd.randrange(10**6) / 1000 for _ in range(3000)] + [rnd.randrange(10**5) / 8 for _ in range(1000)] + [rnd.random() * 10 ** rnd.randint(-6, 9) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in made], "x double")
    rows = df.select("x", deals.two_decimals(F.col("x")).alias("got"), F.format_string("%.2f", "x").alias("before")).collect()
    assert [r.got for r in rows] == ["%.2f" % r.x for r in rows] and any(r.before != r.got for r in rows)
    assert df.where("x = 2.675").select(deals.history_label(F.lit("price_drop"), F.col("x"), F.lit(2))).first()[0] == "DOĞRULANDI (%2.67 geçmiş fiyat düşüşü)"


def test_counters_say_what_is_verified(spark, sf):
    from bazaarlens import queries as Q

    assert Q.QUERIES["deal_counters"](spark, sf).columns == ["candidates", "verified", "below_threshold", "insufficient"] and "verified" in Q.SQL["deal_counters"]


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 3, None)]
    assert sorted(map(tuple, tables.patch(old, F.col("v") > 1, {"w": F.lit(None)}).collect())) == [("a", 1, "x"), ("b", 2, None)]


def test_ingest_twice(spark):
    none = {k: spark.createDataFrame([], s) for k, s in (("merchants", schemas.MERCHANTS), ("products", schemas.PRODUCTS), ("variants", schemas.VARIANTS), ("offers", schemas.OFFERS), ("history", schemas.PRICE_HISTORY))}
    items = spark.createDataFrame([("n11", "1", "B", "Kupa", 5.0, "img", "u1", True, None), ("n11", "", "B", "no id", 5.0, None, "u", True, None), ("vatan", "1", None, "Mug", 6.0, None, "u2", False, None)], schemas.ITEMS)
    first = tables.ingest(items, **none)
    assert {k: v.count() for k, v in first.items()} == {"merchants": 2, "products": 2, "variants": 2, "offers": 2, "price_history": 2}
    again = spark.createDataFrame([("n11", "1", "B", "Kupa", 4.0, "new", "u1", True, None), ("vatan", "1", None, "Mug", 6.5, "new", "u2", True, None)], schemas.ITEMS)
    second = tables.ingest(again, first["merchants"], first["products"], first["variants"], first["offers"], first["price_history"])
    assert {k: v.count() for k, v in second.items()} == {"merchants": 2, "products": 2, "variants": 2, "offers": 2, "price_history": 4}
    assert {r.merchant_product_id + r.merchant_id: (r.price, r.updated_at) for r in second["offers"].collect()} == {"1m-n11": (4.0, NOW), "1m-vatan": (6.5, NOW)}
    assert {r.sku: r.image_url for r in second["variants"].collect()} == {"n11:1": "new", "vatan:1": None}
    assert {r.slug: r.image_url for r in second["products"].collect()} == {"n11-1": "new", "vatan-1": None}


def test_ingested_offers_are_found_in_one_pass(spark, sf):
    """New offers take their variant's id from the sku, so the plan doesn't build products and variants before."""
    from bazaarlens import page_queries as P

    plan = P.ingest_offers(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 4 and plan.count("Window [") == 1
    old = {"merchants": [("m", "M", "a", None, True)], "variants": [("v", "p", None, "a:2", None, True)]}
    table = lambda name, schema: spark.createDataFrame(old.get(name, []), schema)
    items = spark.createDataFrame([(s, k, "B", "Kupa", 5.0, None, u, True, None) for s, k, u in (("a", "1", "u1"), ("a", "1", "u2"), ("a", "2", "u"), ("b", "1", "u"), (None, "1", "u"))], schemas.ITEMS)
    offers = spark.createDataFrame([("x", None, "m", "1", "u0", 9.0, "TRY", False, None, NOW, NOW)], schemas.OFFERS)
    out = tables.ingest(items, table("merchants", schemas.MERCHANTS), table("products", schemas.PRODUCTS), table("variants", schemas.VARIANTS), offers, table("history", schemas.PRICE_HISTORY))
    got = {(r.id, r.product_variant_id, r.merchant_id, r.product_url) for r in out["offers"].collect()}
    assert got == {("x", None, "m", "u2"), ("o-a:2", "v", "m", "u"), ("o-b:1", "v-b:1", "m-b", "u")}


def test_store_and_stream(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    offers = spark.createDataFrame([("a", 1.0, True, NOW)], "id string, price double, in_stock boolean, last_checked_at timestamp")
    store.overwrite("offers", offers)
    rows = [("a", 2.0, True, NOW), ("a", 3.0, True, NOW + timedelta(hours=1)), ("b", 9.0, False, NOW), ("a", 2.0, True, NOW)]
    spark.createDataFrame(rows, schemas.PRICE_HISTORY).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        prices.start(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/ck").awaitTermination()
    assert {r.id: r.price for r in store.read("offers").collect()} == {"a": 3.0, "b": 9.0}
    assert store.read("price_history").count() == 3
    store.patch("offers", F.col("id") == "b", {"price": F.lit(1.5)})
    store.append("offers", offers.withColumn("id", F.lit("z")))
    assert {r.id: r.price for r in store.read("offers").collect()} == {"a": 3.0, "b": 1.5, "z": 1.0}
    with pytest.raises(LookupError):
        store.read("nothing")


def test_pipeline_over_adapted_tables(spark, sf):
    out = catalog.price_pipeline(adapters.all_tables(spark, sf))
    assert out["feed"].count() > 0 and out["deal_candidates"].columns == [c.split()[0] for c in schemas.DEALS.split(", ")]


def test_category_tree(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version": 1, "categories": [{"name": "A", "slug": "a", "subcategories": [{"name": "x", "slug": "x", "queries": [" ", "q1 ", "q2"]}, {"name": "y", "slug": "y", "active": false, "queries": ["q"]}, {"name": "z", "slug": "z", "queries": []}]}, {"name": "B", "slug": "b", "active": false, "subcategories": [{"name": "w", "slug": "w", "queries": ["q"]}]}]}')
    tree = catalog.read_tree(spark, f"file://{tmp_path}/c.json")
    rows = catalog.active_subcategories(tree).collect()
    assert [(r.subcategory_slug, r.query, r.aliases) for r in rows] == [("x", "q1", ["q2"])]
    assert catalog.active_subcategories(tree, slug="none").count() == 0 and catalog.active_subcategories(tree, limit=0).count() == 1


def test_late_batches_and_conflicts(spark, tmp_path):
    """A batch that comes late or again: history holds it once, a newer price stays; versions are kept apart."""
    from bazaarlens.sources.store import WriteConflict

    store = TableStore(spark, f"file://{tmp_path}/late")
    run = prices.apply_batch(store)
    rows = lambda *x: spark.createDataFrame([(o, p, True, datetime(2024, 1, day)) for o, p, day in x], schemas.PRICE_HISTORY)
    run(rows(("a", 5.0, 20), ("b", 7.0, 20)), 0)
    before = store.read("price_history")
    late = rows(("a", 4.0, 10), ("c", 1.0, 3), ("b", 8.0, 21))
    run(late, 1)
    run(late, 1)
    assert before.count() == 2 and store.read("price_history").count() == 5
    assert {r.id: r.price for r in store.read("offers").collect()} == {"a": 5.0, "b": 8.0, "c": 1.0}
    number, paths = store._version("offers")
    # one of two writers of a version loses, whichever comes first, and nothing of the winner is lost
    store._publish("offers", number + 1, [*paths, "winner"])
    with pytest.raises(WriteConflict):
        store._publish("offers", number + 1, paths)
    assert store._version("offers") == (number + 1, [*paths, "winner"])
    # a job that was lost between its claim and its pointer: told, until somebody gives up its claim
    where, files = store._claim("offers", number + 2)
    assert files.createNewFile(where)
    with pytest.raises(WriteConflict):
        store._publish("offers", number + 2, paths)
    store.release("offers")
    store._publish("offers", number + 2, paths)
    assert store._version("offers") == (number + 2, paths)


def test_two_cheapest_are_cut_before_the_shuffle(spark):
    can, match, var, off = shop(spark, {"a": [85.0, 100.0, 90.0], "b": [1.0]})
    gaps = deals.ranked_gaps(deals.offer_groups(can, match, var, off))
    assert "WindowGroupLimit" in gaps._jdf.queryExecution().executedPlan().toString()
    assert {r.canonical_product_id: (r.n_merchants, r.cheapest_price, r.competitor_price) for r in gaps.collect()} == {"a": (3, 85.0, 90.0), "b": (1, 1.0, None)}


def test_replay_of_history(spark):
    """Frames of time end with each snapshot; snapshots of one time see each other, unpriced ones count nowhere."""
    rows = [(10.0, 100), (20.0, 95), (8.0, 60), (0.0, 50), (9.0, 31), (9.5, 31), (7.0, 0)]
    hist = spark.createDataFrame([("o", p, True, NOW - timedelta(days=d)) for p, d in rows], schemas.PRICE_HISTORY)
    got = {(r.price, (NOW - r.checked_at).days): (r.history_points, round(r.history_avg_30d, 6), r.history_low_90d, round(r.mean_drop_percent, 6)) for r in deals.history_replay(hist).collect()}
    assert got == {
        (10.0, 100): (1, 10.0, 10.0, 0.0), (20.0, 95): (2, 15.0, 10.0, 0.0), (8.0, 60): (3, 8.0, 8.0, 0.0), (9.0, 31): (5, 8.833333, 8.0, 0.0), (9.5, 31): (5, 8.833333, 8.0, 0.0), (7.0, 0): (4, 7.0, 7.0, 0.0),
    }


def test_streamed_life_cycle(spark, tmp_path):
    """Deals move on with each batch; late and repeated snapshots change nothing, and the stream goes on where it was."""
    from bazaarlens.streaming import deals as streamed

    batches = [
        [("a", "s", 100.0, True, 1), ("a", "t", 70.0, True, 1), ("b", "s", 5.0, True, 1), (None, "s", 1.0, True, 1)],
        [("a", "t", 70.0, True, 1), ("a", "t", 10.0, True, 0), ("b", "t", 4.9, True, 2)],
        [("a", "t", 95.0, True, 3), ("b", "t", 2.0, False, 3)],
        [("a", "u", 50.0, True, 4), ("b", "t", 3.0, True, 4), ("a", "t", 1.0, None, 5)],
        [("b", "s", 5.0, False, 6), ("a", "s", None, True, 9)],
    ]
    want = {("a", 1): ("candidate", "candidate", 70.0, 100.0), ("b", 1): ("insufficient", None, 5.0, None), ("a", 2): ("candidate", "candidate", 70.0, 100.0), ("b", 2): ("normal", None, 4.9, 5.0),
            ("a", 3): ("normal", "expired", 95.0, 100.0), ("b", 3): ("insufficient", None, 5.0, None), ("a", 4): ("candidate", "candidate", 50.0, 100.0), ("b", 4): ("candidate", "candidate", 3.0, 5.0), ("b", 5): ("insufficient", "expired", 3.0, None)}
    found = None
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(c, m, p, s, NOW + timedelta(hours=h)) for c, m, p, s, h in rows], streamed.SNAPSHOTS)
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if k != 1:  # two files in one call, a batch each
            found = streamed.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = {(r.canonical_product_id, r.version): (r.outcome, r.status, r.cheapest_price, r.competitor_price) for r in found.collect()}
    assert got == want
    assert {r.canonical_product_id: r.version for r in streamed.final_states(found).collect()} == {"a": 4, "b": 5}


def test_state_is_asked_once_for_a_merchant():
    """1,000 snapshots of three merchants, in batches out of order, against a pass over all."""
    import pandas as pd

    from bazaarlens.streaming.deals import DealProcessor

    class Newest(dict):
        calls = 0

        def iterator(self):
            Newest.calls += 1
            return iter(list(self.items()))

        def updateValue(self, key, value):
            Newest.calls += 1
            self[key] = value

    class Deal:
        value = None
        exists, get = (lambda self: self.value is not None), (lambda self: self.value)

        def update(self, value):
            self.value = value

    rnd = random.Random(8)
    rows = [(rnd.choice("abc"), rnd.randint(0, 300), float(rnd.randint(0, 9)), rnd.random() < 0.7) for _ in range(1000)]
    process = DealProcessor()
    process.newest, process.deal = Newest({("a",): (500, 4.0, True)}), Deal()
    frames = (pd.DataFrame(rows[k : k + 100], columns=["merchant_id", "at", "price", "in_stock"]) for k in range(0, 1000, 100))
    list(process.handleInputRows(("p",), frames, None))
    assert process.newest == {("a",): (500, 4.0, True), **{(m,): max(r[1:] for r in rows if r[0] == m) for m in "bc"}} and Newest.calls <= 3
