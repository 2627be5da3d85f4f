"""Operator 11: conversation prefix trie with count-min screening.

A node is a distinct sequence of first turns. Its key is 128 bits, the exclusive or over its turns of hashes of
(position, digest of role and text), so keys of all prefixes are running aggregates and a long conversation is split
into blocks of turns. A count-min sketch counts the keys of all prefixes. Where a key's estimate is one, no other
conversation has the prefix: its node is finished where it is read, without a shuffle. Only prefixes that may be
shared are grouped exactly, and sums over subtrees come from them alone: each shared node's value is held by its
smallest member, summed from the deepest turn up in each conversation, and added over the members of a node.

The sketch has ROWS rows of a power of two of cells, at least four for each prefix and at most CELLS; beyond that
load more prefixes pass the screen, and results stay the same. Counters stop at two. What is broadcast is a bit for
each cell: 12 MB at most.

Sizes: ids that end at a node are hashed in ascending order, which is one chain by definition; they come in chunks of
CHUNK ids, made in parallel, and are read as a stream.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), ties by role, then by digest
of the text; repeated rows are repeated turns. A null conv_id is one more conversation: it counts as a member, is the
smallest only where it is the only one, and has no part in ``ends_sha256``. Other columns are not read. An empty table
has no nodes, not even a root. Functions here store intermediate tables, so they run jobs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Rows and most cells a row of the sketch; cells that are merged at a time.
ROWS, CELLS, SEGMENT = 3, 1 << 25, 1 << 16
#: Turns of a conversation that one task sums up in order; ids in a chunk.
BLOCK, CHUNK = 1024, 4096
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``(conv_id, k, digest, n_bytes)``: the turns of each conversation, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.rand(7).alias("salt"))
    # the salt, last in order, parts equal rows, so that no key is too large for a part
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "salt"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes")
    schema = pa.schema([("conv_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("part", pa.int32()), ("k", pa.int64())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last = TaskContext.get().partitionId(), 0, -1  # the id that came last, None for null
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            k = np.arange(len(ids)) - start + 1
            if before and last == (None if null[0] else ids[0]):
                k[start == 0] += before
            before, last = int(k[-1]), None if null[-1] else ids[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), part, np.int32)), pa.array(k, pa.int64())], schema=schema)

    own = materialize(ranged.mapInArrow(numbered, "conv_id long, digest binary, n_bytes long, part int, k long"), "turns")
    counts = own.groupBy("conv_id", "part").agg(F.max("k").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a part continues another part's: at most one row for each part
    going_on = F.broadcast(counts.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.sum("n").over(upto).alias("earlier")).where("earlier > 0"))
    joined = own.join(going_on, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    return joined.select("conv_id", (F.col("k") + F.coalesce("earlier", F.lit(0))).alias("k"), "digest", "n_bytes")


def conversation_sizes(turns: DataFrame) -> DataFrame:
    """``(conv_id, size)`` of numbered turns."""
    return turns.groupBy("conv_id").agg(F.max("k").alias("size"))


def with_borrowed_heads(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: ``(conv_id, size)`` and turns ``(conv_id, k, digest, n_bytes)``.

    Conversation c gets the first h turns of c - c % ``every`` in place of its own first h, where h is crc32 of c in
    decimal, modulo ``most``. A null id keeps its turns.
    """
    ident = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    own = conversation_sizes(turns).withColumn("h", F.crc32(ident.cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    own = materialize(own, "conversations")
    sizes = own.select(F.col("conv_id").alias("base"), F.col("size").alias("there"))
    own = own.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    own = materialize(own.withColumn("total", F.col("head") + F.greatest(F.lit(0), F.col("size") - F.col("h"))).select("conv_id", "base", "h", "head", "total"), "conversations")
    k = F.col("k")
    tails = turns.join(own.select(F.col("conv_id").alias("c"), "h", "head"), F.col("conv_id").eqNullSafe(F.col("c"))).where("k > h")
    tails = tails.select("conv_id", (k - F.col("h") + F.col("head")).alias("k"), "digest", "n_bytes")
    heads = turns.where(k < most).withColumnRenamed("conv_id", "base").join(own.select("conv_id", "base", "head"), "base").where("k <= head")
    return own.select("conv_id", F.col("total").alias("size")), tails.unionByName(heads.select("conv_id", "k", "digest", "n_bytes"))


def prefixes(sizes: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, k, size, n_bytes, a, b, pa, pb)``: each conversation's prefixes with their keys and their parents' keys."""
    size = sizes.select(F.col("conv_id").alias("c"), "size")
    rows = turns.withColumn("blk", F.expr(f"(k - 1) div {block}"))
    rows = rows.withColumn("ha", F.xxhash64("k", "digest")).withColumn("hb", F.xxhash64(F.lit(1), "k", "digest"))
    within = Window.partitionBy("conv_id", "blk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "blk", "k", "n_bytes", "ha", "hb", F.bit_xor("ha").over(within).alias("a"), F.bit_xor("hb").over(within).alias("b"))
    full = rows.where(f"k % {block} = 0")
    upto = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    before = full.select(F.col("conv_id").alias("c"), (F.col("blk") + 1).alias("to"), F.bit_xor("a").over(upto).alias("ba"), F.bit_xor("b").over(upto).alias("bb"))
    rows = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("blk") == F.col("to")), "left").drop("c")
    rows = rows.join(size, F.col("conv_id").eqNullSafe(F.col("c")))
    a, b = (F.col(x).bitwiseXOR(F.coalesce(y, F.lit(0))) for x, y in (("a", "ba"), ("b", "bb")))
    return rows.select("conv_id", "k", "size", "n_bytes", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ha")).alias("pa"), b.bitwiseXOR(F.col("hb")).alias("pb"))


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return [((a + b * np.uint64(2 * r + 1)) * _FACTORS[r] >> np.uint64(64 - bits)).astype(np.int64) for r in range(ROWS)]


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def sketch(keys: DataFrame, cells: int) -> np.ndarray:
    """A bit for each cell of the count-min sketch of keys (a, b), packed by row: whether two or more were counted."""
    bits, seg = cells.bit_length() - 1, min(SEGMENT, cells)
    out = pa.schema([("segment", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            for row, at in zip(table, _cells(_numpy(batch, "a"), _numpy(batch, "b"), bits)):
                cell, n = np.unique(at, return_counts=True)
                row[cell] = np.minimum(2, row[cell] + np.minimum(2, n))
        for k, part in enumerate(table.reshape(-1, seg)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(data), np.uint8)
                held[k] = np.minimum(2, held[k] + part) if k in held else part
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(part > 1).tobytes()], pa.binary())], schema=out)

    schema = "segment int, counts binary"
    merged = keys.select("a", "b").mapInArrow(count, schema).repartition("segment").mapInArrow(merge, schema)
    shared = np.zeros((ROWS * cells // seg, max(1, seg // 8)), np.uint8)
    for k, data in merged.toLocalIterator():  # ROWS * cells bits at most
        shared[k] = np.frombuffer(data, np.uint8)
    return shared.reshape(ROWS, -1)


def screened(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` with ``maybe`` and ``pmaybe``: whether the key, and the parent's key, may be shared."""
    bits = cells.bit_length() - 1
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows, cells))
    fields = [(f.name, pa.int64()) for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*fields, ("maybe", pa.bool_()), ("pmaybe", pa.bool_())])
        for batch in batches:
            flags = []
            for x, y in (("a", "b"), ("pa", "pb")):
                found = np.ones(batch.num_rows, bool)
                for row, at in zip(shared.value, _cells(_numpy(batch, x), _numpy(batch, y), bits)):
                    found &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                flags.append(pa.array(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], schema=schema)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n, _ in fields) + ", maybe boolean, pmaybe boolean")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)`` of rows (a, b, conv_id): the digest of each key's ids, ascending."""
    chunked = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    done = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for (a, b), group in groupby(zip(*(c.to_pylist() for c in batch.columns)), lambda r: r[:2]):
                ids = [r[2] for r in group]
                made += [(a, b, ids[at], ",".join(map(str, ids[at : at + CHUNK]))) for at in range(0, len(ids), CHUNK)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), chunked)], schema=chunked)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b), group in groupby(rows(batches), lambda r: r[:2]):
            digest = hashlib.sha256(next(group)[3].encode())
            for r in group:
                digest.update(b"," + r[3].encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((a, b, digest.hexdigest()), done)], schema=done)

    order = ["a", "b", "conv_id"]
    pieces = ends.where("conv_id IS NOT NULL").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunk, "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hash_all, "a long, b long, ends_sha256 string")


def _ends(one: Column) -> Column:
    return F.sha2(F.coalesce(one.cast("string"), F.lit("")), 256)


def trie(sizes: DataFrame, turns: DataFrame, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations ``sizes`` (conv_id, size) with ``turns`` (conv_id, k, digest, n_bytes):
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
    spark = turns.sparkSession
    rows = materialize(prefixes(sizes, turns, block), "prefixes")
    least = 4 * rows.count()
    cells = cells or min(CELLS, max(1 << 12, 1 << least.bit_length()))
    rows = materialize(screened(rows, cells), "screened")
    every = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.count_if(F.col("size") == 0).alias("turnless"), F.min(F.when(F.col("size") == 0, F.col("conv_id"))).alias("end")).first()

    # nodes that one conversation has, proven by the sketch, are finished here
    alone = rows.where("NOT maybe")
    c, k, size = F.col("conv_id"), F.col("k"), F.col("size")
    zero, root = F.lit(0).cast("long"), F.lit(every["first"]).cast("long")

    def single(parent: Column) -> list[Column]:
        last = k == size
        return [c, k.alias("depth"), parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
                F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, _ends(c)).otherwise(F.lit(_NOTHING)).alias("ends_sha256")]

    tails = alone.where("k = 1 OR NOT pmaybe").select(*single(F.when(k == 1, root).otherwise(c)))
    forks = alone.where("k > 1 AND pmaybe")

    # the others are grouped exactly
    may = rows.where("maybe")
    is_end = k == size
    groups = may.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("k").alias("k"), F.max("size").alias("size"), F.max("n_bytes").alias("n_bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
        F.count_if(is_end).alias("n_ends"), F.min(F.when(is_end, c)).alias("end"),
    )
    groups = materialize(groups, "nodes")
    kids = groups.where("k > 1").select("pa", "pb").unionAll(forks.select("pa", "pb")).groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = groups.where("n > 1").join(kids.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"), ["a", "b"], "left")
    nodes = materialize(nodes.fillna(0, ["n_children"]), "shared")
    parents = groups.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    # a parent that isn't grouped is one conversation's, so it is the child's own
    over = F.when(k == 1, root).otherwise(F.coalesce("above", c))
    forked = forks.join(parents, ["pa", "pb"], "left").select(*single(over))
    rare = groups.where("n = 1").join(parents, ["pa", "pb"], "left").select(*single(over))

    # sums over subtrees
    facts = nodes.select("a", "b", "n", F.col("conv_id").alias("holder"), "n_children", "n_ends")
    held = may.join(facts, ["a", "b"]).withColumn("blk", F.expr(f"(k - 1) div {block}"))
    holds = F.coalesce(c == F.col("holder"), F.lit(False))
    held = held.select("conv_id", "k", "size", "a", "b", "blk", "n_ends", F.when(holds, (F.col("n") - 1) * F.col("n_bytes")).otherwise(0).alias("value"), F.when(holds & is_end & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"))
    held = materialize(held, "members")
    totals = held.groupBy("conv_id", "blk").agg(F.sum("value").alias("v"), F.sum("leaf").alias("l"), F.max("k").alias("deep"), F.max("size").alias("size"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    # below its last shared turn a conversation goes on alone to a leaf of its own
    own_leaf = (F.max("deep").over(whole) < F.col("size")).cast("long")
    totals = totals.select(F.col("conv_id").alias("c"), F.col("blk").alias("at"), F.coalesce(F.sum("v").over(later), zero).alias("v"), (F.coalesce(F.sum("l").over(later), zero) + own_leaf).alias("l"))
    down = Window.partitionBy("conv_id", "blk").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.select("a", "b", "conv_id", "blk", F.sum("value").over(down).alias("value"), F.sum("leaf").over(down).alias("leaf"))
    sums = sums.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("blk") == F.col("at"))).groupBy("a", "b").agg(F.sum(F.col("value") + F.col("v")).alias("saved_tokens"), F.sum(F.col("leaf") + F.col("l")).alias("n_leaves"))

    # ids that end at a node, where there are two or more
    turnless = sizes.where("size = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")
    ends = held.where((F.col("n_ends") > 1) & is_end).select("a", "b", "conv_id").unionAll(turnless)
    ends = materialize(hashed_ends(ends), "ends")
    found = nodes.join(sums, ["a", "b"]).join(ends, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    shared = found.select(
        c, k.alias("depth"), over.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce(F.when(F.col("n_ends") > 1, F.col("ends_sha256")), _ends(F.col("end"))).alias("ends_sha256"),
    )

    below = tails.unionAll(forked).unionAll(rare).unionAll(shared)
    if not every["n"]:
        return below
    below = materialize(below, "trie")
    tops = nodes.agg(F.coalesce(F.sum((F.col("n") - 1) * F.col("n_bytes")), zero).alias("saved_tokens"))
    top = below.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1).cast("long")).alias("n_leaves"))
    hashed = ends.where("a = 0 AND b = 0").agg(F.coalesce(F.max("ends_sha256"), F.lit(_NOTHING)).alias("ends_sha256"))
    facts = [x.first() for x in (top, tops, hashed)]  # a row each
    first = spark.range(1).select(
        root.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(every["n"]).cast("long").alias("n_convs"), F.lit(facts[0]["n_children"]).cast("long").alias("n_children"),
        F.lit(facts[0]["n_leaves"]).cast("long").alias("n_leaves"), F.lit(facts[1]["saved_tokens"]).cast("long").alias("saved_tokens"), F.lit(facts[2]["ends_sha256"]).alias("ends_sha256"),
    )
    return below.unionAll(first)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = turn_digests(conversations)
    return trie(conversation_sizes(turns), turns)
