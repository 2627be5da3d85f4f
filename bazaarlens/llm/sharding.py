"""Operator 9: sharding by a two-pass external shuffle, in DataFrame functions only.

Equal rows are counted first, which Spark combines before the shuffle, so that a group of copies is
one record with a number; at most a sixteenth of a bucket of them stays together. Pass 1 scatters records into
memory-sized buckets by seeded hashes: the shard of the id, then one of the buckets of its shard by a hash of the
whole row. Pass 2 gathers a bucket, shuffles it (Spark's ``shuffle`` is Fisher-Yates) and writes it; a
row's slot is its place in the bucket after the rows of its shard's earlier buckets.

The law is ``key``: the id and the number of shards alone decide the shard, by the highest of one
seeded hash for each shard (rendezvous hashing), so one more shard takes rows only into itself.

Reruns agree: buckets have partitions fixed in number, are sorted inside them, and a bucket's records
are sorted before they are shuffled with a seed, so a lost task gives the same slots again.

Defined results: a null text counts 8 bytes and its checksum is that of no bytes; all columns are
kept as they are, and internal columns are in one struct of another name; null ids are one key, and
rows with the same id share a shard, but neither share a bucket unless they are equal; an empty table
gives no rows. Columns must have an order, as Spark's ``sort`` needs it (a map has none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

SHARDS, SEED = 24, 20240131
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 16 << 20
LAW = "key"


def shard_of(id_col: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the id is highest; a tie goes to the lower shard."""
    if shards == 1:
        return F.lit(0)
    best = F.greatest(*[F.struct(F.xxhash64(id_col, F.lit(seed + s)).alias("h"), F.lit(-s).alias("s")) for s in range(shards)])
    return (-best["s"]).cast("int")


def grown_shard(id_col: Column, shard: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with one more: that one if its hash is higher than the hash of the present shard."""
    return F.when(F.xxhash64(id_col, F.lit(seed + shards)) > F.xxhash64(id_col, F.lit(seed) + shard), F.lit(shards)).otherwise(shard).cast("int")


def two_pass_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``shard`` and ``slot`` (gapless from 0 in each shard), which replace
    columns of these names. Runs jobs, since it stores the counted rows."""
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 8
    packed = docs.select(F.xxhash64(*columns, F.lit(seed)).alias("_hash"), shard_of(F.col(id_col), shards, seed).alias("_shard"), size.cast("long").alias("_size"), F.struct(*columns).alias("_row"))
    counted = materialize(packed.groupBy("_hash", "_shard", "_size", "_row").agg(F.count(F.lit(1)).alias("_copies")), "counted-rows")
    total = counted.agg(F.sum(F.col("_size") * F.col("_copies"))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    # copies of a row that stay together
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(bucket_bytes // 16) / F.col("_size")))
    chunks = F.ceil(F.col("_copies") / most)

    def scattered(*columns: str) -> DataFrame:
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
        df = counted.select("_hash", "_shard", "_copies", most.alias("_most"), chunk.alias("_chunk"), *columns)
        own = F.least("_most", F.col("_copies") - F.col("_chunk") * F.col("_most")).cast("int")
        return df.select("_shard", F.pmod(F.xxhash64("_hash", "_chunk"), F.lit(per_shard)).cast("long").alias("_bucket"), "_hash", own.alias("_own"), *columns)

    # rows before each bucket; this pass reads no text
    counts = scattered().groupBy("_shard", "_bucket").agg(F.sum("_own").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # a fixed number of partitions: a bucket is about one task
    buckets = scattered("_row").repartition(shards * per_shard, "_shard", "_bucket")
    record = F.struct(F.col("_hash").alias("h"), F.col("_row").alias("row"), F.col("_own").alias("own"))
    buckets = buckets.groupBy("_shard", "_bucket").agg(F.sort_array(F.collect_list(record)).alias("_records")).sortWithinPartitions("_shard", "_bucket")
    copies = F.flatten(F.transform("_records", lambda r: F.array_repeat(r["row"], r["own"])))
    mixed = buckets.select("_shard", "_bucket", F.shuffle(copies, seed).alias("_rows"))
    rows = mixed.select("_shard", "_bucket", F.posexplode("_rows").alias("_pos", "_row")).join(counts, ["_shard", "_bucket"])
    return rows.select("_row.*", F.col("_shard").alias("shard"), (F.col("_first") + F.col("_pos")).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard. Buckets are written where they were shuffled, in order of slot inside a file."""
    shuffled.write.partitionBy("shard").parquet(path)
