"""Operator 13: ranked lexical search of many queries that share their work.

Every item is a query of distinct terms; a document's score for it is the sum of its terms' contributions, integers
from the term's weight, its count in the document and the document's length. Items are dealt into blocks of about
BLOCK (item, term) rows, so what a pass broadcasts (a vocabulary and a graph) has a bound however many items there are.
For each block

1. documents are read once: their length and the counts of the block's terms are stored, and the number of documents
   that hold a term comes from there;
2. term sets that items share are mined: with an item's terms in order of how many items hold them, neighbours that
   are neighbours in two items or more become a node, the sum of two; rounds of this go on over the nodes until no
   two items share neighbours. The result is a graph in which a node is computed once for all items above it;
3. for some documents at a time, the accumulators of all nodes are filled along the graph, each from two others, and
   every item adds up the nodes left to it. A task keeps the best LIMIT documents of each item, and Spark ranks
   what the tasks kept.

Sums are 64-bit integers. Every document meets every item; no document or item is skipped or cut.

Defined results: a null text has no terms; rows that repeat a doc_id are ranked each for itself; of equal scores the
smaller doc_id is first, null ids last. Items that repeat an item_id are one item with all their terms; a null item_id
is one more item; an item without terms, or whose terms no document holds, has no rows. Terms longer than LONG bytes are
known by a 128-bit hash. Other columns are not read. ``search`` runs jobs: it stores counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .common import map_rows

LIMIT = 50
#: (item, term) rows of a block, about; cells of accumulators that a task fills at a time.
BLOCK, CELLS = 1 << 17, 1 << 22
LONG = 48
# terms are runs of ASCII letters and digits and of all other bytes of UTF-8; A-Z are lowered
_KINDS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    found = text.encode().translate(_KINDS).split() if text else []
    if found and max(map(len, found)) > LONG:
        found = [w if len(w) <= LONG else b" " + xxhash.xxh3_128_digest(w) for w in found]
    return found


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, term)``, each once."""
    out = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])
    rows = map_rows(items, [id_col, text_col], lambda i, t: (i, sorted(set(terms(t)))), "item_id long, terms array<binary>", out)
    return rows.select("item_id", F.explode("terms").alias("term")).distinct()


class Graph:
    """Sums of terms that items share. Nodes below ``n_terms`` are terms; node ``starts[r] + i`` is the sum of nodes
    ``left[r][i]`` and ``right[r][i]``, all from before round r. Item i adds up ``nodes[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, items: list[list[int]], n_terms: int):
        self.n_terms, self.size = n_terms, n_terms
        self.starts: list[int] = []
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        lists = [list(x) for x in items]
        while True:
            held = Counter(x for nodes in lists for x in nodes)
            for nodes in lists:
                nodes.sort(key=lambda x: (-held[x], x))
            met = Counter(pair for nodes in lists for pair in zip(nodes, nodes[1:]))
            # pairs of an item that don't overlap, from the most held on; those that two items chose become nodes
            chosen = []
            for nodes in lists:
                k, found = 0, []
                while k + 1 < len(nodes):
                    if met[nodes[k], nodes[k + 1]] > 1:
                        found.append((nodes[k], nodes[k + 1]))
                        k += 1
                    k += 1
                chosen.append(found)
            times = Counter(pair for found in chosen for pair in found)
            made = {pair: self.size + k for k, pair in enumerate(p for p, n in times.items() if n > 1)}
            if not made:
                break
            for nodes, found in zip(lists, chosen):
                found = [p for p in found if p in made]
                gone = {x for p in found for x in p}
                nodes[:] = [x for x in nodes if x not in gone] + [made[p] for p in found]
            self.starts.append(self.size)
            self.left.append(np.array([p[0] for p in made]))
            self.right.append(np.array([p[1] for p in made]))
            self.size += len(made)
        self.nodes = np.array([x for nodes in lists for x in nodes], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(nodes) for nodes in lists])]).astype(np.int64)

    def scores(self, of_terms: np.ndarray) -> np.ndarray:
        """Items by documents, from terms by documents."""
        held = np.zeros((self.size, of_terms.shape[1]), np.int64)
        held[: self.n_terms] = of_terms
        for start, left, right in zip(self.starts, self.left, self.right):
            held[start : start + len(left)] = held[left] + held[right]
        return np.add.reduceat(held[self.nodes], self.bounds[:-1], axis=0)  # each item has a node at least


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _counted(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, terms array<int>, counts array<int>)``: a document's terms that the vocabulary holds, by number."""
    shared = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})

    def row(i: int, text: str | None) -> tuple:
        words = terms(text)
        found = np.fromiter(map(shared.value.get, words, repeat(-1)), np.int32, len(words))
        which, counts = np.unique(found[found >= 0], return_counts=True)
        return i, len(words), which, counts.astype(np.int32)

    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    return map_rows(docs, [id_col, text_col], row, "doc_id long, n long, terms array<int>, counts array<int>", out)


class _Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, limit: int):
        self.limit, self.least, self.kept, self.new = limit, np.zeros(n_items, np.int64), [np.zeros(0, np.int64)] * 4, []

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, doc = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        self.new.append((item, scores[item, doc], null[doc], ids[doc]))
        if sum(len(x[0]) for x in self.new) > 2 * self.limit * len(self.least):
            self.settle()

    def settle(self) -> None:
        item, score, null, ids = (np.concatenate([x, *(n[k] for n in self.new)]) for k, x in enumerate(self.kept))
        order = np.lexsort((ids, null, -score, item))
        item, score = item[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.limit - 1
        self.least[item[last]] = score[last]
        good = place < self.limit
        self.kept, self.new = [item[good], score[good], null[order][good], ids[order][good]], []


def _ranked(counted: DataFrame, graph: Graph, weights: np.ndarray, item_ids: list[int | None], n_docs: int, n_words: int, limit: int) -> DataFrame:
    """``(item_id, doc_id, score)``: the best of each task."""
    shared = counted.sparkSession.sparkContext.broadcast((graph, weights, item_ids))
    out = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights, item_ids = shared.value
        best = _Best(len(item_ids), limit)
        size = max(1, min(512, CELLS // max(1, graph.size + len(graph.nodes))))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                ids, n, found, counts = batch.slice(at, size).columns
                doc = np.repeat(np.arange(len(ids)), np.diff(found.offsets.to_numpy()))
                which, tf = found.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
                m = 50 + 50 * n.to_numpy() * n_docs // n_words
                of_terms = np.zeros((graph.n_terms, len(ids)), np.int64)
                of_terms[which, doc] = weights[which] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                best.add(graph.scores(of_terms), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        best.settle()
        item, score, null, ids = best.kept
        names = pa.array(item_ids, pa.int64()).take(pa.array(item))
        for at in range(0, len(item), 65536):
            part = slice(at, at + 65536)
            yield pa.RecordBatch.from_arrays([names.slice(at, 65536), pa.array(ids[part], pa.int64(), mask=null[part].astype(bool)), pa.array(score[part])], schema=out)

    return counted.where("size(terms) > 0").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``limit`` best documents."""
    wanted = materialize(item_terms(items, item_col, item_text), "item-terms")
    blocks = max(1, -(-wanted.count() // block))
    kept = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()  # a block
        by_item: dict[int | None, list[bytes]] = {}
        for item, term in zip(rows["item_id"].to_pylist(), rows["term"].to_pylist()):
            by_item.setdefault(item, []).append(term)
        if not by_item and (kept is not None or k < blocks - 1):
            continue
        item_ids = sorted(by_item, key=lambda i: (i is None, i))
        vocabulary = sorted({w for found in by_item.values() for w in found})
        number = {w: j for j, w in enumerate(vocabulary)}
        counted = materialize(_counted(docs, vocabulary, id_col, text_col), "counted")
        n_docs, n_words = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row for each term of the block
        df = np.zeros(len(vocabulary), np.int64)
        df[holders["term"].to_numpy()] = holders["df"].to_numpy()
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        graph = Graph([sorted(number[w] for w in by_item[i]) for i in item_ids], len(vocabulary))
        found = _ranked(counted, graph, weights, item_ids, n_docs, max(1, n_words), limit)
        kept = found if kept is None else kept.unionAll(found)
    # a slice of documents first, so that no item's rows of all tasks meet in one
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    best = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "slice").orderBy(*order))).where(F.col("rank") <= limit)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= limit)
    return best.select("item_id", "rank", "doc_id", "score")
