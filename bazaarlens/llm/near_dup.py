"""Operator 8: near duplicates by bottom-k sketches of word shingles.

A document's set holds a 64-bit hash of each distinct SHINGLE-word shingle; the K smallest of these,
under the one hash function, are its sketch. Documents with equal sets are one class. Inverted lists
of retained values bring classes together: a pair with Jaccard similarity THRESHOLD shares
``least_shared`` of its sketch values but for a chance of MISS at most, so it is enough to list each class under the
rarest values of its sketch, that many that two such classes must meet in one. Values that many
classes hold (common passages) are in few lists, and values that no other class holds are in none.

Two rounds then confirm links on full sets. (1) Every class of a list is paired with the list's
class that has the fewest values of its own, the one most like the others; the union sketch estimates each pair, and the best pair of a class is confirmed. Connected
components follow. (2) Classes of lists that still hold more than one component go through the exact
prefix filter: two sets over the threshold meet in one of the rarest shingles of each, before fewer
shingles are left in either than the pair must have in common; shingles that only one set has come
first and list nothing. Each set has a bitmap of the parities of its shingles' hashes in BITS places; where the bitmaps of
two sets differ, so do the sets, so pairs whose bitmaps differ in more places than a link's sets can differ in shingles
are no links and are not made. All other pairs of different components that meet there are confirmed, without
an estimate, and join the components found before. So links inside a component are not confirmed one by one, pairs of a large family that can't
be links are not made, and no link between components is lost for a list's length.

Defined results: words are split at ASCII white space, A-Z is lowered; a set of fewer words than a
shingle has is the whole sequence; null and empty texts have an empty set and no links; rows with the
same id are one document if their texts differ, linked to all that either is linked to; rows with a
null id are linked by their texts like others, their component is the smallest id that they reach and
null if they reach none, and of a group without any id one row is kept; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.storage import materialize

SHINGLE, K = 5, 64
#: Places of the bitmap of a set.
BITS = 512
#: A link's similarity, in hundredths; the chance that the sketches of a pair at the threshold hide it.
THRESHOLD, MISS = 85, 1e-7

_RNG = np.random.default_rng(5)
_FACTORS = [int(x) | 1 for x in _RNG.integers(0, 2**63, 64)]


def least_shared(threshold: int = THRESHOLD, k: int = K) -> float:
    """The share of k sketch values that a pair at the threshold has in common but for a chance of MISS."""
    p, missed, m = threshold / 100, 0.0, 0
    while m < k and (missed := missed + comb(k, m) * p**m * (1 - p) ** (k - m)) <= MISS:
        m += 1
    return m / k


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.full(len(w) - n + 1, n if n < size else 0, np.uint64)  # shorter sequences are of another kind
    for k in range(n):
        total += w[k : len(w) - n + 1 + k] * np.uint64(_FACTORS[k % 64])
    total = (total ^ total >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    total = (total ^ total >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.unique(total ^ total >> np.uint64(31))


def parities(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Longs of ``bits`` bits in all: how many of the values fall on each, modulo 2. Of two sets, as many values
    are in only one of them as bits differ, at least."""
    return np.packbits(np.bincount(values & np.uint64(bits - 1), minlength=bits) & 1 == 1).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, key, th, text)``: the key is the id, or for a null id the hash ``th`` of the text."""
    ident, th = F.col(id_col).cast("long"), F.xxhash64(text_col)
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, th).alias("key"), th.alias("th"), F.col(text_col).alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, key, th, n, sig binary, sketch array<long>)``: set size, digest of the set, its k smallest values."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, size) for t in part.column(3).to_pylist()]
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s[:k].view(np.int64) for s in sets], out.field(5).type)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made], schema=out)

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, key long, th long, n long, sig binary, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(sig, items array<long>, bits array<long>)`` of the classes ``wanted`` (sig, key, th), each from the text that
    stands for it."""
    # rows that repeat id and text are one
    texts = _keyed(docs, id_col, text_col).groupBy("key", "th").agg(F.first("text").alias("text"))
    rows = texts.join(wanted.select("key", "th", "sig"), ["key", "th"]).select("sig", "text")
    out = pa.schema([("sig", pa.binary()), ("items", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                made = [pa.array([s.view(np.int64) for s in sets], out.field(1).type), pa.array(map(parities, sets), out.field(2).type)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], schema=out)

    return rows.mapInArrow(run, "sig binary, items array<long>, bits array<long>")


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Similarity from the k smallest values of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _rarest(values: DataFrame, owner: str, take: Column) -> DataFrame:
    """``(v, owner, of, alone, place)``: of the rows (v, owner, of) of each owner, its rarest values,
    ``take`` of them, numbered from 1. Values that no other owner has (``alone`` of them) are numbered
    first, but can't bring two owners together and are left out."""
    # stored, so that both sides of the join are plain shuffles, which Spark can split where a value is frequent
    shared = materialize(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    rows = values.join(shared.hint("merge"), "v")
    by = Window.partitionBy(owner)
    rows = rows.withColumn("alone", F.col("of") - F.count(F.lit(1)).over(by))
    return rows.withColumn("place", F.col("alone") + F.row_number().over(by.orderBy("df", "v"))).where(F.col("place") <= take).select("v", owner, "of", "alone", "place")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("items").alias("ai")), "a").join(sets.select(F.col("sig").alias("b"), F.col("items").alias("bi")), "b")
    same = F.size(F.array_intersect("ai", "bi"))
    return both.where(100 * same >= threshold * (F.size("ai") + F.size("bi") - same)).select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, shared: float, threshold: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and union sketch allow a link, with the estimate."""
    of = lambda x: classes.select(F.col("sig").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("an", "bn") >= threshold * F.greatest("an", "bn"))
    return both.withColumn("e", _estimate(F.col("as"), F.col("bs"), k)).where(F.col("e") >= shared).select("a", "b", "e")


def _apart(sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of the sets (sig, comp, items, bits) that may be links, by the exact prefix filter and their
    bitmaps, and are in different components."""
    own = sets.select(F.xxhash64("sig").alias("id"), F.size("items").cast("long").alias("of"), F.explode("items").alias("v"))
    larger = F.col("of") - F.ceil(F.col("of") * threshold / 100) + 1
    smaller = F.col("of") - F.ceil(F.col("of") * 2 * threshold / (100 + threshold)) + 1
    rare = _rarest(own, "id", larger).join(sets.select(F.xxhash64("sig").alias("id"), "sig", "comp", "bits"), "id")
    short = rare.where(F.col("place") <= smaller).select("v", F.col("sig").alias("y"), F.col("of").alias("yn"), F.col("comp").alias("yc"), F.col("place").alias("yp"), F.col("bits").alias("ybits"))
    near = (F.col("comp") != F.col("yc")) & (F.col("yn") <= F.col("of")) & (100 * F.col("yn") >= threshold * F.col("of"))
    # what two sets of these sizes must have in common; they must meet before so many are left in either
    common = F.ceil(threshold * (F.col("of") + F.col("yn")) / (100 + threshold) - 1e-9)
    near = near & (F.col("place") <= F.col("of") - common + 1) & (F.col("yp") <= F.col("yn") - common + 1)
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("ybits")[k])) for k in range(BITS // 64)), F.lit(0))
    near = near & (differ <= F.col("of") + F.col("yn") - 2 * common)
    met = rare.join(short, (rare["v"] == short["v"]) & near)
    return met.select(F.least("sig", "y").alias("a"), F.greatest("sig", "y").alias("b")).distinct()


def _renamed(pairs: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """``(src, dst)``: the pairs (a, b) of sets by a ``name`` that ``names`` (sig, name) gives."""
    ids = names.select("sig", F.col(name).alias("to"))
    named = pairs.join(ids.withColumnsRenamed({"sig": "a", "to": "src"}), "a").join(ids.withColumnsRenamed({"sig": "b", "to": "dst"}), "b")
    return named.select("src", "dst")


def class_components(docs: DataFrame, sketched: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE, threshold: int = THRESHOLD, shared: float | None = None) -> DataFrame:
    """``(sig, comp, real)`` for each class with words: equal ``comp`` if links connect them, and ``real``, the
    smallest id in the component or null. ``sketched`` is stored. Runs jobs, since it stores tables."""
    shared = least_shared(threshold, k) if shared is None else shared
    own = sketched.where("n > 0")
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "key", "th"))
    classes = own.groupBy("sig").agg(first_of.alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select("sig", "at.*", "n", "sketch"), "classes")
    values = classes.select("sig", F.size("sketch").cast("long").alias("of"), F.explode("sketch").alias("v"))
    lists = materialize(_rarest(values, "sig", F.col("of") - F.ceil(F.col("of") * shared) + 1).select("v", "sig", "alone"), "lists")

    leaders = materialize(lists.groupBy("v").agg(F.min(F.struct("alone", "sig")).alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1").select("v", F.col("a.sig").alias("a")), "leaders")
    listed = lists.join(leaders.hint("merge"), "v")
    light = classes.select("sig", "none", "key", "th")
    wanted = listed.select("sig").distinct().join(light, "sig")
    sets = materialize(_full_sets(docs, wanted, id_col, text_col, size), "sets")

    star = listed.where("a <> sig").select("a", F.col("sig").alias("b")).distinct()
    star = _estimated(star, classes, k, shared, threshold)
    best = star.groupBy("b").agg(F.max_by("a", F.struct("e", "a")).alias("a")).select("a", "b")
    first = materialize(_confirmed(best, sets, threshold), "links")
    comps = connected_components(_renamed(first, light, "key"))
    found = light.join(comps, F.col("key") == F.col("node"), "left").select("sig", "none", "key", F.coalesce("component", "key").alias("comp"))
    found = materialize(found, "components")

    now = materialize(listed.join(found, "sig").select("v", "sig", "comp"), "lists-apart")
    mixed = now.groupBy("v").agg((F.min("comp") < F.max("comp")).alias("mixed")).where("mixed").select("v")
    open_ = materialize(now.join(mixed.hint("merge"), "v").select("sig", "comp").distinct().join(sets, "sig"), "open")
    second = materialize(_confirmed(_apart(open_, threshold), sets, threshold), "links")
    # an id with several texts is in several classes
    repeated = own.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    several = own.select("doc_id", "sig").join(repeated, "doc_id").distinct().join(found, "sig")
    several = several.join(several.groupBy("doc_id").agg(F.min("comp").alias("src")), "doc_id").select("src", F.col("comp").alias("dst")).where("src < dst").distinct()
    # the rest connects components found before
    more = connected_components(_renamed(second, found, "comp").unionByName(several))
    found = found.join(more, F.col("comp") == F.col("node"), "left").select("sig", F.coalesce("component", "comp").alias("comp"), F.when(~F.col("none"), F.col("key")).alias("id"))
    # a component's node may be the hash of a text
    return found.join(found.groupBy("comp").agg(F.min("id").alias("real")), "comp").select("sig", "comp", "real")


def _decided(docs: DataFrame, id_col: str, text_col: str, **parameters) -> DataFrame:
    """``(doc_id, th, n, component_id, kept)`` for every row."""
    size, k = parameters.get("size", SHINGLE), parameters.get("k", K)
    # rows are numbered once, where they are stored
    sketched = materialize(sketches(docs, id_col, text_col, k, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # stored, so that both sides of the join are plain shuffles, which Spark can split where a set is frequent
    named = materialize(class_components(docs, sketched, id_col, text_col, **parameters), "named").hint("merge")
    rows = sketched.select("doc_id", "th", "n", "sig", "row")
    with_id = rows.where("doc_id is not null").join(named, "sig", "left")
    own = F.when(F.col("n") > 0, F.col("real")).otherwise(F.col("doc_id"))
    with_id = with_id.select("doc_id", "th", "n", own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))
    without = rows.where("doc_id is null").join(named, "sig", "left")
    first = without.where("n > 0 and real is null").groupBy("comp").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    without = without.join(first, "row", "left").select("doc_id", "th", "n", F.col("real").alias("component_id"), (F.coalesce("first", F.lit(False)) | (F.col("n") == 0)).alias("kept"))
    return with_id.unionByName(without)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row. Runs jobs, since it stores tables."""
    return _decided(docs, id_col, text_col, **parameters).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of near duplicates and
    repeated rows, the one with the smallest id; of groups without any id one row. Texts without words
    stay, once for each id and all of those with a null id."""
    kept = materialize(_decided(docs, id_col, text_col, **parameters).where("kept"), "kept")
    ids = kept.where("doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc_nulls_last(text_col)))
    stay = docs.join(ids, id_col, "left_semi").withColumn("_nth_of_id", nth).where("_nth_of_id = 1").select(*docs.columns)
    null_id = docs.where(F.col(id_col).isNull())
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = kept.where("doc_id is null and n > 0").select(F.col("th").alias("_text_hash"))
    nth = F.row_number().over(Window.partitionBy("_text_hash").orderBy(text_col))
    one = null_id.where(words).withColumn("_text_hash", F.xxhash64(text_col)).join(texts, "_text_hash", "left_semi").withColumn("_nth_of_text", nth).where("_nth_of_text = 1").select(*docs.columns)
    return stay.unionByName(one).unionByName(null_id.where(~words))
