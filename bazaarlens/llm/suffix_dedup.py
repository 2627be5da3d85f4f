"""Operator 5: removal of repeated byte strings by threshold-bounded interval expansion.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same
document or another. The strings of a document that share their least hashed anchor (ANCHOR bytes)
follow each other, and equal strings have equal anchors; so documents are cut into segments, each
strings of one anchor (MOST at most, where a period repeats it), and only segments whose anchor comes twice can hold a
repeat. Equal segments
are counted once, with a weight. Segments are dealt into bins by their anchors, and each bin's text
gets a Burrows-Wheeler transform: intervals of suffixes are extended backward breadth-first, so
common prefixes come by increasing length, and expansion stops at LENGTH. Neighbours without a
shorter common prefix then share LENGTH bytes or more, and a string is repeated if its neighbours so
joined weigh two or more.

An anchor with more than HOT distinct segments (a passage that very many documents share, each with
text of its own around it) is cut finer before it is dealt: into single strings of LENGTH bytes,
whose copies are counted before they move, so such a group is not gathered either.

Rows are known by two keys, the id (for a null id a hash of the text) and a hash of the text; rows with
equal keys are the same text with the same id, so they get the same spans.

Defined results: a null or empty text has no bytes; rows with a null id count and are judged like
others; rows that repeat an id are documents of their own; other columns are not read; an empty table
gives no rows; texts are judged whole, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

LENGTH, ANCHOR = 200, 48
#: Bytes of text in a bin, on average.
BIN_BYTES = 1 << 20
#: Distinct segments of an anchor (of about 256 bytes) that would fill a bin alone; above, it is cut finer.
HOT = BIN_BYTES // 256
#: Bytes of documents that are hashed at once; at most 1 << 20.
CHUNK = 1 << 20
#: Strings of a segment at most; a segment of text without a period has LENGTH - ANCHOR + 1 or fewer.
MOST = 2048

_RNG = np.random.default_rng(48)
_BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(step: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, step, np.uint64))


_FORWARD = _powers(int(_STEP), CHUNK)
_BACKWARD = _powers(pow(int(_STEP), -1, 2**64), CHUNK)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser with good low and high bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes in a row; long data are hashed in parts, with equal results."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    if len(data) > CHUNK:
        step = CHUNK - size + 1
        return np.concatenate([window_hashes(data[k : k + CHUNK], size) for k in range(0, len(data) - size + 1, step)])
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _FORWARD[:n], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * _BACKWARD[: n - size + 1])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def segments(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string, last string, times) of each segment of a document, given as bytes.

    A string's anchor is its least hash, so equal strings have equal anchors, wherever a segment is cut. A segment is a
    run of strings with one anchor, of ``most`` (MOST) strings at most. ``times`` is 2 where the anchor comes at several places
    of the segment, as in periodic text, so that the segment may repeat its own strings, else 1. Long data go through
    in parts, so that memory does not grow with them, but for what is returned."""
    found = []
    for at in range(0, len(data) - length + 1, CHUNK - length + 1):
        h = window_hashes(data[at : at + CHUNK], anchor)
        bits = np.uint64(20)  # the upper bits order, the lower ones tell the place
        place = np.arange(len(h), dtype=np.uint64)
        spot = (sliding_min(h >> bits << bits | place, length - anchor + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        anchors = h[spot]
        new = np.ones(len(spot), bool)
        new[1:] = anchors[1:] != anchors[:-1]
        starts = np.flatnonzero(new)
        number = np.arange(len(spot)) - np.repeat(starts, np.diff(np.append(starts, len(spot))))
        starts = np.flatnonzero(number % (most or MOST) == 0)
        moved = np.zeros(len(spot), np.int64)
        moved[1:] = spot[1:] != spot[:-1]
        moved[starts] = 0
        found.append((anchors[starts], starts + at, np.append(starts[1:], len(spot)) - 1 + at, 1 + np.minimum(1, np.add.reduceat(moved, starts))))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if not k else np.int64) for k in range(4))


# ---- Burrows-Wheeler transform and interval expansion -------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least. Symbols are 1 to 256; 0 ends a piece,
    each end differs from all others, in any order. The last symbol is 0."""
    n = len(symbols)
    used = np.flatnonzero(np.bincount(symbols, minlength=257))
    dense = np.zeros(257, np.uint64)
    dense[used] = np.arange(len(used))
    bits = max(1, int(len(used) - 1).bit_length())
    span = 63 // bits
    padded = np.concatenate([dense[symbols], np.zeros(span, np.uint64)])
    key = padded[:n].copy()
    for k in range(1, span):
        key <<= np.uint64(bits)
        key |= padded[k : n + k]
    ends = np.flatnonzero(symbols == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    done = left < span
    # nothing from the end on counts
    key &= ~((np.uint64(1) << np.uint64(bits) * np.arange(span, -1, -1, dtype=np.uint64)) - np.uint64(1))[np.minimum(left, span)]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | done[order[1:]]  # a suffix that has met its end is alone
    places, rows = np.arange(n), order
    rank = np.empty(n, np.int64)
    while True:
        # groups of the rows that were together so far; a group's rank is its first place
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        rank[rows] = np.repeat(places[starts], sizes)
        together = np.repeat(sizes > 1, sizes)
        places, rows = places[together], rows[together]
        if span >= depth or not len(rows):
            return order
        # no suffix of such a group meets its end within span symbols, so the next rank exists
        after = rank[np.minimum(rows + span, n - 1)]
        if n < 1 << 21:  # two further ranks fit; past an end, the second means nothing and the first is unique
            both = rank[rows] << 42 | after << 21 | rank[np.minimum(rows + 2 * span, n - 1)]
        else:
            both = rank[rows] << 32 | after
        by = np.argsort(both)
        rows, both = rows[by], both[by]
        order[places] = rows
        new = np.ones(len(rows), bool)
        new[1:] = both[1:] != both[:-1]
        span *= 3 if n < 1 << 21 else 2


def shared_prefix_bounds(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order, whether the suffix shares fewer than ``length`` symbols with the
    one before it.

    Breadth-first: from the interval of all suffixes, an interval of suffixes that start with w gives,
    for each symbol c before them, the interval of cw, found through the transform as a run of places.
    The place after an interval gets the present length as its common prefix when it has none yet,
    and then the interval is expanded further. Expansion stops at ``length``.
    """
    n = len(symbols)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = order - 1
    last_to_first = place[before]  # of the first suffix too; its symbol before is an end
    last_to_first[symbols[before] == 0] = -1
    first = symbols[order]
    known = np.zeros(n + 1, bool)
    known[: np.count_nonzero(symbols == 0) + 1] = True  # ends differ from each other and from all symbols
    known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    mark = np.zeros(n + 1, np.int32)
    for _ in range(length):
        sizes = high - low + 1
        total = int(sizes.sum())
        if not total:
            break
        ids = np.repeat(np.arange(1, len(low) + 1, dtype=np.int32), sizes)
        rows = np.arange(total, dtype=np.int32) + np.repeat((low - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        to = last_to_first[rows]  # -1 after an end
        inner = to >= 0
        to, ids = to[inner], ids[inner]
        if len(to) > n >> 4:
            mark[:] = 0
            mark[to] = ids
            to = np.flatnonzero(mark)
            ids = mark[to]
        else:
            by = np.argsort(to)
            to, ids = to[by], ids[by]
        if not len(to):
            break
        breaks = np.flatnonzero((to[1:] != to[:-1] + 1) | (ids[1:] != ids[:-1]) | (first[to[1:]] != first[to[:-1]]))
        low = to[np.append(0, breaks + 1)]
        high = to[np.append(breaks, len(to) - 1)]
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
    return known[:n]


def repeated_starts(pieces: list[bytes], windows: list[int], weights: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each piece, the runs (first, last) of its first ``windows`` places at which a string of
    ``length`` bytes starts that weighs two or more among all pieces."""
    sizes = np.array([len(p) + 1 for p in pieces])
    symbols = np.empty(int(sizes.sum()), np.uint16)
    at = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols[:] = at
    symbols += 1
    ends = np.cumsum(sizes) - 1
    symbols[ends] = 0
    starts = ends + 1 - sizes
    order = suffix_order(symbols, length)
    group = np.cumsum(shared_prefix_bounds(symbols, order, length)) - 1
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    weight = np.where(place < np.repeat(windows, sizes), np.repeat(weights, sizes), 0)
    total = np.bincount(group, weight[order])
    twice = np.zeros(len(symbols) + 1, bool)
    twice[order] = total[group] > 1.5
    twice[:-1] &= weight > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice])))  # a piece ends with a place of no weight
    firsts, lasts = edges[::2], edges[1::2] - 1
    owner = np.searchsorted(ends, firsts)
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for p, a, b in zip(owner.tolist(), (firsts - starts[owner]).tolist(), (lasts - starts[owner]).tolist()):
        out[p].append((a, b))
    return out


# ---- on documents -------------------------------------------------------------------------------


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, bytes]]:
    """(values of the other columns, the text's bytes); the text is the last column."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()
            for *values, text in zip(*(c.to_pylist() for c in part.columns[:-1]), texts):
                yield values, text or b""


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _key_fields(keys: list[str]) -> list[tuple[str, pa.DataType]]:
    return [(k, pa.int64()) for k in keys]


def _keys_ddl(keys: list[str]) -> str:
    return ", ".join(f"{k} long" for k in keys)


def _occurrences(docs: DataFrame, keys: list[str], length: int, anchor: int) -> DataFrame:
    """(anchor, seg, keys, first, last, times): every segment, with a hash of its bytes."""
    out = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), *_key_fields(keys), ("first", pa.int32()), ("last", pa.int32()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0
        for values, text in _texts(batches):
            anchors, first, last, times = segments(np.frombuffer(text, np.uint8), length, anchor)
            if len(first):
                digest = xxhash.xxh3_64_intdigest
                seg = np.fromiter((digest(text[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                parts.append([anchors.view(np.int64), seg.view(np.int64), *(np.full(len(first), v, np.int64) for v in values), first.astype(np.int32), last.astype(np.int32), times.astype(np.int32)])
                held += len(first)
            if held >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=out)
                parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=out)

    return docs.select(*keys, "text").mapInArrow(run, f"anchor long, seg long, {_keys_ddl(keys)}, first int, last int, times int")


def _pieces(docs: DataFrame, distinct: DataFrame, keys: list[str], length: int) -> DataFrame:
    """The bytes of distinct segments, from the document that stands for each; hot ones as single strings."""
    wanted = distinct.groupBy(*keys).agg(F.collect_list(F.struct("anchor", "seg", "weight", "first", "last", "hot")).alias("found"))
    # rows that repeat a key have one text, which would give its pieces once for each row
    rows = wanted.join(docs.groupBy(*keys).agg(F.first("text").alias("text")), keys).select("found", "text")
    out = pa.schema([("piece", pa.binary()), ("anchor", pa.int64()), ("seg", pa.int64()), ("offset", pa.int32()), ("hot", pa.bool_()), ("weight", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for (found,), text in _texts(batches):
            for s in found:
                a, n = s["first"], s["last"] - s["first"] + 1
                if not s["hot"]:
                    made.append((None, s["anchor"], s["seg"], 0, False, s["weight"], n, text[a : a + n - 1 + length]))
                    held += n + length
                else:
                    for k in range(n):
                        part = text[a + k : a + k + length]
                        made.append((xxhash.xxh3_128_digest(part), s["anchor"], s["seg"], k, True, s["weight"], 1, part))
                    held += n * length
                if held >= CHUNK:
                    yield _table(made, out)
                    made, held = [], 0
        if made:
            yield _table(made, out)

    return rows.mapInArrow(run, "piece binary, anchor long, seg long, offset int, hot boolean, weight long, windows int, bytes binary")


def _judged(pieces: DataFrame, bins: int, length: int) -> DataFrame:
    """(piece, anchor, seg, runs): pieces with repeated strings, judged bin by bin."""
    out = pa.schema([("piece", pa.binary()), ("anchor", pa.int64()), ("seg", pa.int64()), ("runs", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))])

    def run(table: pa.Table) -> pa.Table:
        found = repeated_starts(table["bytes"].to_pylist(), table["windows"].to_numpy(), table["weight"].to_numpy(), length)
        keep = [k for k, runs in enumerate(found) if runs]
        names = table.select(["piece", "anchor", "seg"]).take(keep)
        runs = pa.array([[{"x": x, "y": y} for x, y in found[k]] for k in keep], out.field("runs").type)
        return pa.table([*names.columns, runs], schema=out)

    binned = pieces.withColumn("bin", F.pmod("dealt", F.lit(bins)))
    return binned.select("bin", "piece", "anchor", "seg", "windows", "weight", "bytes").groupBy("bin").applyInArrow(run, "piece binary, anchor long, seg long, runs array<struct<x: int, y: int>>")


def repeated_spans(docs: DataFrame, keys: list[str], length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """``(keys, spans array<struct<a, b>>)``: for each document with repeats, spans [a, b) of bytes that
    repeated strings cover; they may overlap. ``docs`` has the keys and ``text``, and keys are unique."""
    found = materialize(_occurrences(docs, keys, length, anchor), "segments")
    # stored, so that both sides of the join are plain shuffles, which Spark can split where an anchor is frequent
    again = materialize(found.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "again")
    places = materialize(found.join(again.hint("merge"), "anchor"), "anchors")
    distinct = places.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct(*keys, "first", "last")).alias("at"))
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    distinct = distinct.join(kinds.hint("merge"), "anchor").select("anchor", "seg", "weight", "at.*", (F.col("kinds") > hot).alias("hot"))
    distinct = materialize(distinct, "distinct-segments")
    size = distinct.agg(F.sum(F.col("last") - F.col("first") + length)).first()[0]
    bins = max(1, -(-(size or 0) // bin_bytes))
    pieces = materialize(_pieces(docs, distinct, keys, length), "pieces")
    names = ["anchor", "seg"]
    # copies of a single string are counted before they move
    single = pieces.where("hot")
    counted = single.groupBy("piece").agg(F.sum("weight").alias("weight"), F.first("bytes").alias("bytes")).where("weight > 1")
    nothing = F.lit(0).cast("long")
    counted = counted.select("piece", nothing.alias("anchor"), nothing.alias("seg"), "weight", F.lit(1).alias("windows"), "bytes", F.xxhash64("piece").alias("dealt"))
    whole = pieces.where("not hot").select("piece", *names, "weight", "windows", "bytes", F.xxhash64("anchor").alias("dealt"))
    judged = materialize(_judged(whole.unionByName(counted), bins, length), "judged")
    again = judged.where("piece is not null").select("piece")
    of_single = single.select("piece", *names, "offset").join(again, "piece").select(*names, F.array(F.struct(F.col("offset").alias("x"), F.col("offset").alias("y"))).alias("runs"))
    runs = judged.where("piece is null").select(*names, "runs").unionByName(of_single)
    spans = places.join(runs, names).select(*keys, F.transform("runs", lambda r: F.struct((F.col("first") + r["x"]).alias("a"), (F.col("first") + r["y"] + length).alias("b"))).alias("s"))
    return spans.groupBy(*keys).agg(F.flatten(F.collect_list("s")).alias("spans"))


def without_spans(text: bytes, spans: list) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many runs are removed."""
    gone = merged(spans)
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), len(gone)


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of the union; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in (() if spans is None else spans)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


KEYS = ["doc_key", "text_key"]


def with_keys(docs: DataFrame, id_col: str, text_col: str, *columns: str) -> DataFrame:
    """``(doc_key, text_key, doc_id, columns, text)`` of every row; equal keys mean equal ids and texts."""
    ident, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(F.coalesce(ident, F.xxhash64(F.lit("no id"), text)).alias("doc_key"), F.xxhash64(ident.isNull(), text).alias("text_key"), ident.alias("doc_id"), *columns, text.alias("text"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = (), **parameters) -> DataFrame:
    """``columns``, the id, ``text`` and ``spans`` (null without repeats) of every row."""
    rows = with_keys(docs, id_col, text_col, *columns)
    return rows.join(repeated_spans(rows.select(*KEYS, "text"), KEYS, **parameters), KEYS, "left")


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row."""
    judged = with_spans(docs, id_col, text_col, **parameters)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for (doc_id, spans), text in _texts(batches):
            kept, n = without_spans(text, spans)
            made.append((doc_id, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            if len(made) == 1024:
                yield _table(made, out)
                made = []
        if made:
            yield _table(made, out)

    return judged.select("doc_id", "spans", "text").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents with repeated strings cut from ``text``, other columns as they were. A removed run
    is narrowed to whole characters, so that what is left is text; ``n_chars``, if present, is set anew."""
    names = docs.columns
    others = [c for c in names if c not in (id_col, text_col)]
    # other columns travel in a struct, so that their names can't clash
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in others], F.lit(None).alias("_end")).alias("rest"))
    judged = with_spans(packed, columns=("rest",), **parameters)

    def cut(text: str, spans: list) -> str:
        data = text.encode()
        whole = []
        for a, b in merged(spans):
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            whole.append({"a": a, "b": b})
        return without_spans(data, whole)[0].decode()

    @F.pandas_udf("string")
    def cut_all(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else cut(t, s) for t, s in zip(texts, spans)], dtype=object)

    # only rows with repeats go through Python
    done = judged.where("spans is null").unionByName(judged.where("spans is not null").withColumn("text", cut_all("text", "spans")))
    done = done.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col), *[F.col(f"rest.`{c}`").alias(c) for c in others])
    if "n_chars" in others:
        done = done.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return done.select(*names)
