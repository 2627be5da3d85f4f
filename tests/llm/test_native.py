"""Mixing and sharding, which run without Python."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import mixing, sharding
from bazaarlens.llm.queries import OP6_SQL

SCHEMA = "doc_id long, text string, source string, size string"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_mix_equals_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.execute(OP6_SQL)
    names = [c[0] for c in rel.description]
    want = {r[names.index("doc_id")]: (r[names.index("source_size")], r[names.index("target")], r[names.index("taken")]) for r in rel.fetchall()}
    df = mixing.mix(mixing.sizes(docs))
    assert not any(x in plan(df) for x in ("Python", "Pandas", "Arrow"))
    assert {r.doc_id: (r.source_size, r.target, r.size * r.copies) for r in df.collect()} == want


def test_targets(spark):
    def of(rows):
        df = mixing.targets(spark.createDataFrame(rows, "source string, source_size long"))
        return {r.source: r.target for r in df.collect()}

    assert of([("a", 100), ("b", 100), ("c", 100)]) == pytest.approx({"a": 200, "b": 250 / 3, "c": 500 / 3})  # a is at twice its size
    assert of([("a", 100)]) == {"a": 150}
    assert of([("a", 10), ("b", 0), (None, 1000)])[None] == pytest.approx(1495)
    assert of([]) == {}


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", "x", ""), (1, "a b c", "x", ""), (1, "d", "x", ""), (None, "e f", None, ""), (2, None, "x", ""), (3, "", "only empty", ""), (4, "w " * 5000, "y", ""), (5, "g\x1fh\xa0i j", "z", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(mixing.sizes(docs)).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == [0, 0, 1, 2, 2, 3, 3, 5000]
    assert all(0 <= r.copies <= 2 for r in got) and all(r.copies == 0 for r in got if r.source == "only empty")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(tuple(r) for r in out.collect()).total() == sum(r.copies for r in got)
    assert mixing.mix(mixing.sizes(docs.limit(0))).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mix_of_hot_ids_equals_sql(spark):
    """Null ids, equal rows and rows that share an id, more than a slice of them."""
    rows = [(None, "a b c", "x")] * 5000 + [(None, "d " * (k % 40), "x") for k in range(3000)] + [(9, "e f", "y")] * 300 + [(9, "g", "x")] * 20 + [(k, "h i j k", None) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    rel = con.execute(OP6_SQL)
    names = [c[0] for c in rel.description]
    want = Counter(tuple(None if (v := r[names.index(n)]) != v else v for n in ("doc_id", "size", "source_size", "target", "taken")) for r in rel.fetchall())
    got = Counter((r.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in mixing.mix(mixing.sizes(docs)).collect())
    assert got == want
    out = mixing.mixed(docs)
    taken, largest = Counter(), 40
    for r in out.collect():
        taken[r.source] += len(r.text.split())
    for source, target in {(r.source, r.target) for r in mixing.mix(mixing.sizes(docs)).select("source", "target").distinct().collect()}:
        assert abs(taken[source] - target) <= 2 * largest


def test_mix_is_near_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text"), F.expr("if(doc_id % 3 = 0, 'hot', source)").alias("source"))
    rows = mixing.mix(mixing.sizes(docs)).collect()
    taken, largest = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    for r in rows:
        assert abs(taken[r.source] - r.target) <= 2 * max(largest.values())
    assert sum(taken.values()) <= 1.5 * sum(r.size for r in rows)
    again = mixing.mix(mixing.sizes(docs.repartition(7))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("shard_", F.lit(1)).withColumn("_bucket", F.lit("mine"))
    df = sharding.two_pass_shuffle(docs, bucket_bytes=3000)
    assert not any(x in plan(df) for x in ("Python", "Pandas", "Arrow"))
    rows = df.collect()
    assert df.columns == [*docs.columns, "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in rows) == sorted(map(tuple, docs.collect()))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = sharding.two_pass_shuffle(docs.repartition(5), bucket_bytes=3000).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, rows))
    grown = {r.doc_id: r.shard for r in sharding.two_pass_shuffle(docs, shards=25).collect()}
    told = {r.doc_id: (r.shard, r.g) for r in df.select("doc_id", "shard", sharding.grown_shard(F.col("doc_id"), F.col("shard"), 24).alias("g")).collect()}
    assert {i: g for i, (_, g) in told.items()} == grown
    assert all(g in (s, 24) for s, g in told.values()) and any(g == 24 for _, g in told.values())


def test_order_is_shuffled(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.two_pass_shuffle(docs, shards=1, bucket_bytes=1 << 20).orderBy("slot").collect()
    ids = [r.doc_id for r in rows]
    rising = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 1850 < rising < 2150


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8, 9), (2, "c", "t", 1, 2, 3)], "doc_id long, text string, source string, shard int, slot int, copies int")
    rows = sharding.two_pass_shuffle(docs)
    assert sorted(rows.columns) == sorted(docs.columns) and rows.where("copies in (9, 3)").count() == 2
    assert mixing.mixed(docs).columns == docs.columns


def test_shards_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, "a", ""), (None, "x", "b", ""), (1, "", "c", ""), (1, "", "c", ""), (2, "é" * 9000, None, "")], SCHEMA)
    rows = sharding.two_pass_shuffle(docs).collect()
    assert len(rows) == 5 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.two_pass_shuffle(docs.limit(0)).count() == 0
    sharding.write_shards(sharding.two_pass_shuffle(docs), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5


def test_shard_by_plain_python(spark):
    """Rendezvous hashing again: Spark gives one hash for each id and shard, plain Python picks."""
    n = 24
    df = spark.range(-50, 400).select(F.col("id").alias("doc_id")).unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    hashes = [F.xxhash64("doc_id", F.lit(sharding.SEED + s)).alias(f"h{s}") for s in range(n + 1)]
    rows = df.select("doc_id", *hashes, sharding.shard_of(F.col("doc_id"), n).alias("shard")).withColumn("grown", sharding.grown_shard(F.col("doc_id"), F.col("shard"), n)).collect()
    for r in rows:
        own = [r[f"h{s}"] for s in range(n + 1)]
        assert r.shard == max(range(n), key=lambda s: (own[s], -s)) and r.grown == max(range(n + 1), key=lambda s: (own[s], -s))
    held = Counter(r.shard for r in rows)
    assert len(held) == n and max(held.values()) < 45


def test_copies_are_spread(spark):
    """A third of all rows are equal, another third have a null id: no bucket holds more than its share of them."""
    rows = [(7, "same text") for _ in range(3000)] + [(None, f"text {k}") for k in range(3000)] + [(k, f"other {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = sharding.two_pass_shuffle(docs, shards=2, bucket_bytes=4000)
    got = df.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for shard in (0, 1):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == 7}) == len({r.shard for r in got if r.doc_id is None}) == 1
    parts = Counter(r.p for r in df.select(F.spark_partition_id().alias("p")).collect())
    assert max(parts.values()) < 1500
    again = Counter(map(tuple, sharding.two_pass_shuffle(docs.repartition(7), shards=2, bucket_bytes=4000).collect()))
    assert again == Counter(map(tuple, got))


def test_query_columns(spark, sf):
    from bazaarlens.llm import queries

    rows = queries.op9_two_pass_shuffle(spark, sf).collect()
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.size == len(text[r.doc_id]) + 8 and 0 <= r.shard < 24 for r in rows)


def test_mix_is_no_single_large_plan(spark, sf):
    """What the driver plans at once is bounded: the mix is stored where it would repeat the plan above."""
    out = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))
    assert out._jdf.queryExecution().sparkPlan().toString().count("Aggregate") < 8
