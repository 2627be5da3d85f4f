"""Operator 4: nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest Euclidean distance by one more component: a vector x, divided
by the largest norm, gets sqrt(1 - |x|^2), a query is divided by its own norm and gets 0. Each of TABLES tables hashes a vector to
floor((a_j . x + b_j) / WIDTH) for Gaussian directions a_j, as many as give CELL_ROWS vectors a bucket. The
index is a row (table, bucket, vector) for each vector and table.

A query visits buckets of a table, its own and perturbed ones, in order of estimated success: the
chance that a vector as near as its LIMIT-th nearest falls there, which is a product of Gaussian
intervals, one for each hash. It stops when the chances of its buckets in all tables add up to RECALL, however many
buckets that takes, or when it has all buckets within a step of each hash; PROBES is how many it looks at first. How near the LIMIT-th nearest is, is estimated from SAMPLE vectors, with which each query is compared;
they also give a score that LIMIT vectors reach, and below it no candidate is kept.

Queries and vectors meet by equal (table, bucket): buckets are dealt into parts of about PART_ROWS vectors,
a query goes to the parts of its buckets only, and in a part it is multiplied with the vectors of its
buckets. A bucket with more than PART_ROWS vectors is split into pieces, and its queries into others.
Candidates of all tables are merged and ranked by the inner product of the original vectors in double
precision. A query with too few candidates is compared with all vectors, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; rows with a null id do, after all ids where scores tie. A query is compared with the vectors of its length. Rows that repeat an id
are candidates each for itself; a query's own row is one with its id and its vector. Of equal vectors the
LIMIT + 1 smallest ids can be among a query's nearest, so the rest is not indexed; that is exact. Ties go to the smaller id; with
fewer candidates than LIMIT, all are returned; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, log2, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..plans.storage import materialize

LIMIT = 20
TABLES, WIDTH, CELL_ROWS = 8, 2.5, 4
#: The chance of finding the LIMIT-th nearest at which a query stops, and how many buckets of a table it looks at first.
RECALL, PROBES = 0.93, 512
NO_ID = (1 << 63) - 1
#: Vectors on the driver, by which buckets are estimated.
SAMPLE = 4096
#: Vectors of a part, and queries that meet a piece of a large bucket.
PART_ROWS, QUERY_ROWS = 65536, 4096

_RNG = np.random.default_rng(4)
_FACTORS = _RNG.integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BELOW = np.frompyfunc(lambda z: 0.5 * (1 + erf(z / sqrt(2))), 1, 1)
#: The Gaussian distribution function as a table.
_GRID = np.linspace(-8, 8, 4097)
_CDF = _BELOW(_GRID).astype(float)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, noid, v)`` of the rows that take part; a row without an id has NO_ID, so that ids stay whole numbers in tasks."""
    v = F.col("v")
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ident = F.col(id_col).cast("long")
    rows = vectors.select(F.coalesce(ident, F.lit(NO_ID)).alias("id"), ident.isNull().alias("noid"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    return rows.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def bits_of_hash(width: float) -> float:
    """How many bits a hash of a Gaussian value has, over all offsets."""
    edges = np.arange(-8, 8, width)
    at = np.linspace(0, width, 64, endpoint=False)[:, None] + np.append(edges, edges[-1] + width)
    p = np.diff(np.interp(at, _GRID, _CDF), axis=1)
    return float(-(p * np.log2(np.maximum(p, 1e-300))).sum() / len(at))


@dataclass
class Index:
    """Hashing and probing for vectors of one length."""

    rows: int
    largest: float
    sample: np.ndarray
    limit: int = LIMIT
    seed: int = 7
    tables: int = TABLES
    width: float = WIDTH
    recall: float = RECALL
    probes: int = PROBES
    cell_rows: int = CELL_ROWS

    def directions(self, table: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(1, round(log2(max(2, self.rows / self.cell_rows)) / bits_of_hash(self.width)))
        rng = np.random.default_rng([self.seed, self.sample.shape[1], table])
        return rng.normal(size=(self.sample.shape[1] + 1, n)), rng.uniform(0, self.width, n)

    @staticmethod
    def named(cells: np.ndarray) -> np.ndarray:
        """One number for the hashes of a bucket."""
        x = (cells.astype(np.int64).view(np.uint64) * _FACTORS[np.arange(cells.shape[-1]) % 256]).sum(axis=-1, dtype=np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(31)).view(np.int64)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        a, b = self.directions(table)
        unit = x / self.largest
        unit = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))[:, None]])
        return self.named(np.floor((unit @ a + b) / self.width))

    def nearness(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query: about how near its limit-th nearest is, between unit vectors, and a score that ``limit`` vectors
        other than its own reach."""
        scores = q @ self.sample.T
        scale = np.sqrt((q * q).sum(1)) * self.largest
        m = scores.shape[1]
        best = -np.sort(-scores, axis=1)
        least = best[:, self.limit] - 1e-9 * scale if m > self.limit else np.full(len(q), -np.inf)
        if self.rows <= 2 * self.limit or m < 3:
            return np.full(len(q), -0.99), least
        best /= scale[:, None]
        rank = max(3, int(1.5 * self.limit * m / self.rows)) + 1
        held = best[:, rank] if m > rank else best[:, -1]
        tail = best.mean(axis=1) + best.std(axis=1) * NormalDist().inv_cdf(1 - self.limit / self.rows)
        return np.clip(np.maximum(held, np.minimum(tail, best[:, 1])), -0.99, 0.99), least

    def visited(self, q: np.ndarray, near: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(query's place, bucket) of all buckets that queries visit, by query and then by estimated success. Queries whose
        best ``probes`` buckets don't reach the wanted chance look at four times as many, until they reach it or have
        all buckets within a step of each hash."""
        left, probes, found = np.arange(len(q)), self.probes, []
        while len(left):
            again = []
            for at in range(0, len(left), step := max(1, (1 << 19) // probes)):
                some = left[at : at + step]
                cells, n, short = self.best(q[some], near[some], table, probes)
                done = ~short
                who = np.repeat(some[done], n[done])
                found.append((who, cells[done][np.arange(cells.shape[1]) < n[done, None]]))
                again.append(some[short])
            left, probes = np.concatenate(again), 4 * probes
        who, cells = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(who, kind="stable")
        return who[order], cells[order]

    def best(self, q: np.ndarray, near: np.ndarray, table: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``probes`` buckets of each query in order of estimated success, how many of them it visits, and whether
        it wants more than there are. A bucket is built hash by hash; as the chances multiply, the best beginnings hold
        all beginnings of the best."""
        a, b = self.directions(table)
        at = (q / np.sqrt((q * q).sum(1))[:, None]) @ a[:-1]
        mean, spread = near[:, None] * at, np.sqrt(1 - near * near)[:, None]
        own = np.floor((mean + b) / self.width)
        cells, cost = np.zeros((len(q), 1, 0)), np.zeros((len(q), 1))
        for j in range(len(b)):
            around = own[:, j, None] + np.arange(-1, 2)
            low = around * self.width - b[j] - mean[:, j, None]
            p = np.interp((low + self.width) / spread, _GRID, _CDF) - np.interp(low / spread, _GRID, _CDF)
            total = (cost[:, :, None] - np.log(np.maximum(p, 1e-30))[:, None, :]).reshape(len(q), -1)
            n = min(probes, total.shape[1])
            keep = np.argpartition(total, n - 1, axis=1)[:, :n]
            cost = np.take_along_axis(total, keep, 1)
            cells = np.concatenate([np.take_along_axis(cells, (keep // 3)[:, :, None], 1), np.take_along_axis(around, keep % 3, 1)[:, :, None]], axis=2)
        order = np.argsort(cost, axis=1, kind="stable")
        chance = np.cumsum(np.exp(-np.take_along_axis(cost, order, 1)), axis=1)
        enough = 1 - (1 - self.recall) ** (1 / self.tables)
        n = (chance < enough).sum(axis=1) + 1
        short = (n > order.shape[1]) & (order.shape[1] < 3.0 ** len(b))
        return np.take_along_axis(self.named(cells), order, 1), np.minimum(n, order.shape[1]), short


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal vectors get equal scores, whatever stands beside them."""
    return np.concatenate([np.add.reduce(rows[k : k + 65536] * queries[k : k + 65536], axis=1) for k in range(0, len(rows), 65536)]) if len(rows) else np.zeros(0)


FOUND = "q long, query_id long, row long, vec_id long, noid boolean, score double, own boolean"


def best_in_part(mine: pd.DataFrame, asked: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The best ``limit`` + 1 of each query among the vectors of its buckets in one part."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    nothing = pd.DataFrame({n: np.zeros(0, np.int64) for n in names}).astype({"noid": bool, "score": float, "own": bool})
    if mine.empty or asked.empty:
        return nothing
    mine = mine.sort_values("cell", kind="stable")
    x, q = np.stack(mine.v.to_numpy()).astype(float), np.stack(asked.v.to_numpy()).astype(float)
    cells, starts = np.unique(mine.cell.to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(mine))
    who, cell = np.repeat(np.arange(len(asked)), asked.cells.map(len)), np.concatenate(asked.cells.to_numpy())
    place = np.searchsorted(cells, cell)
    met = cells[np.minimum(place, len(cells) - 1)] == cell
    who, place = who[met], place[met]
    order = np.argsort(place, kind="stable")
    who, place = who[order], place[order]
    least = asked.least.to_numpy()
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for at, n in zip(*np.unique(place, return_counts=True)) if len(place) else ():
        a, b = starts[at], ends[at]
        first = np.searchsorted(place, at)
        step = max(1, (1 << 21) // (b - a))
        for k in range(first, first + n, step):
            some = who[k : min(k + step, first + n)]
            i, j = np.nonzero(q[some] @ x[a:b].T >= least[some, None])
            pairs.append((some[i], a + j))
    if not pairs:
        return nothing
    i, j = map(np.concatenate, zip(*pairs))
    score = exact_scores(q[i], x[j]) if len(i) < 1 << 20 else np.concatenate([exact_scores(q[i[k : k + (1 << 16)]], x[j[k : k + (1 << 16)]]) for k in range(0, len(i), 1 << 16)])
    ids, noid = mine.id.to_numpy(), mine.noid.to_numpy()
    order = np.lexsort((noid[j], ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) <= limit
    i, j, score = i[keep], j[keep], score[keep]
    qids = asked.qid.to_numpy()[i]
    own = (ids[j] == qids) & (noid[j] == asked.noid.to_numpy()[i]) & (x[j] == q[i]).all(axis=1)
    return pd.DataFrame(dict(zip(names, (asked.q.to_numpy()[i], qids, mine.row.to_numpy()[j], ids[j], noid[j], score, own))))


def _by_length(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.iloc[k : k + 256]
            for dim, rows in part.groupby(part.v.map(len)):
                yield int(dim), rows, np.stack(rows.v.to_numpy()).astype(float)


def nearest(vectors: DataFrame, queries: DataFrame, limit: int = LIMIT, part_rows: int = PART_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", **parameters) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row the best found among all other vectors.
    ``parameters`` are those of ``Index``. Runs jobs, since it stores tables."""
    few = F.row_number().over(Window.partitionBy("v").orderBy("id", "noid"))
    x = materialize(usable(vectors, id_col, vector_col).withColumn("nth", few).where(F.col("nth") <= limit + 1).select(F.monotonically_increasing_id().alias("row"), "id", "noid", "v"), "ann-vectors")
    q = materialize(usable(queries, id_col, vector_col).select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("qid"), "noid", "v"), "ann-queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))
    sizes = x.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("rows"), F.max(norm).alias("largest")).collect()  # a row for each length of vectors
    picked: dict[int, list] = {}
    for r in x.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect():
        picked.setdefault(len(r.v), []).append(r.v)
    index = {r.dim: Index(r.rows, r.largest, np.array(picked.get(r.dim, np.zeros((0, r.dim))), float), limit, **parameters) for r in sizes}
    parts = {dim: -(-own.rows // part_rows) for dim, own in index.items()}

    def hashed(whole: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for dim, rows, v in _by_length(batches):
                for t in range(index[dim].tables):
                    cell = index[dim].cells(v, t)
                    out = pd.DataFrame({"dim": dim, "t": t, "cell": cell})
                    yield out.assign(part=cell % parts[dim], row=rows.row.to_numpy(), id=rows.id.to_numpy(), noid=rows.noid.to_numpy(), v=rows.v.to_numpy()) if whole else out

        return run

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, rows, v in _by_length(batches):
            if dim not in index:
                continue
            near, least = index[dim].nearness(v)
            for t in range(index[dim].tables):
                who, cell = index[dim].visited(v, near, t)
                part = cell % parts[dim]
                order = np.lexsort((part, who))
                who, cell, part = who[order], cell[order], part[order]
                cuts = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                i = who[cuts]
                yield pd.DataFrame({"dim": dim, "t": t, "part": part[cuts], "q": rows.q.to_numpy()[i], "qid": rows.qid.to_numpy()[i], "noid": rows.noid.to_numpy()[i], "v": rows.v.to_numpy()[i], "least": least[i], "cells": np.split(cell, cuts[1:])})

    v_type = x.schema["v"].dataType.simpleString()
    large = x.mapInPandas(hashed(False), "dim int, t int, cell long").groupBy("dim", "t", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows)
    large = materialize(large.select("dim", "t", "cell", F.ceil(F.col("n") / part_rows).alias("pieces")), "ann-large")
    probes = materialize(q.mapInPandas(probed, f"dim int, t int, part long, q long, qid long, noid boolean, v {v_type}, least double, cells array<long>"), "ann-probes")
    q_pieces = F.lit(max(1, -(-q.count() // QUERY_ROWS)))
    nothing = F.lit(0).cast("long")
    group = ["dim", "t", "part", "piece", "q_piece"]

    indexed = x.mapInPandas(hashed(True), f"dim int, t int, cell long, part long, row long, id long, noid boolean, v {v_type}").join(large, ["dim", "t", "cell"], "left")
    split = F.col("pieces").isNotNull()
    vectors_of = ["cell", "row", "id", "noid", "v"]
    mine = indexed.select("dim", "t", F.when(split, F.col("cell")).otherwise(F.col("part")).alias("part"), F.when(split, F.pmod(F.xxhash64("row"), "pieces")).otherwise(F.lit(-1)).alias("piece"), F.explode(F.sequence(nothing, F.when(split, q_pieces - 1).otherwise(0).cast("long"))).alias("q_piece"), *vectors_of)
    queries_of = ["q", "qid", "noid", "v", "least", "cells"]
    asked = probes.select("dim", "t", "part", F.lit(-1).cast("long").alias("piece"), nothing.alias("q_piece"), *queries_of)
    in_large = probes.withColumn("cell", F.explode("cells")).join(large, ["dim", "t", "cell"])
    in_large = in_large.select("dim", "t", F.col("cell").alias("part"), F.explode(F.sequence(nothing, F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("q"), q_pieces).alias("q_piece"), "q", "qid", "noid", "v", "least", F.array("cell").alias("cells"))

    def search(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return best_in_part(mine, asked, limit)

    met = mine.groupBy(*group).cogroup(asked.unionByName(in_large).groupBy(*group)).applyInPandas(search, FOUND)
    found = materialize(met.repartition("q").dropDuplicates(["q", "row"]), "ann-found")

    # queries with too few candidates meet all vectors of their length
    counts = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    lengths = q.sparkSession.createDataFrame([(d, i.rows, parts[d]) for d, i in index.items()], "dim int, rows long, blocks long")
    short = q.withColumn("dim", F.size("v")).join(F.broadcast(lengths), "dim").join(counts, "q", "left").where(F.coalesce("n", nothing) < F.least(F.lit(limit + 1), "rows"))
    short = materialize(short.select("dim", "q", "qid", "noid", "v", "blocks"), "ann-short")
    q_pieces = F.lit(max(1, -(-short.count() // QUERY_ROWS)))
    every = F.lit(-1).alias("t")
    rest = x.withColumn("dim", F.size("v")).join(F.broadcast(short.select("dim", "blocks").distinct()), "dim")
    rest = rest.select("dim", every, F.pmod(F.xxhash64("row"), "blocks").alias("part"), nothing.alias("piece"), F.explode(F.sequence(nothing, (q_pieces - 1).cast("long"))).alias("q_piece"), nothing.alias("cell"), "row", "id", "noid", "v")
    short = short.select("dim", every, F.explode(F.sequence(nothing, F.col("blocks") - 1)).alias("part"), nothing.alias("piece"), F.pmod(F.xxhash64("q"), q_pieces).alias("q_piece"), "q", "qid", "noid", "v", F.lit(float("-inf")).alias("least"), F.array(nothing).alias("cells"))
    exact = rest.groupBy(*group).cogroup(short.groupBy(*group)).applyInPandas(search, FOUND)

    all_found = found.unionByName(exact).repartition("q").dropDuplicates(["q", "row"])
    of = Window.partitionBy("q")
    others = all_found.withColumn("mine", F.min(F.when(F.col("own"), F.col("row"))).over(of)).where(F.col("mine").isNull() | (F.col("row") != F.col("mine")))
    ranked = others.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "vec_id", "noid", "row"))).where(F.col("rank") <= limit)
    asked_by = q.select("q", F.col("noid").alias("q_noid"))
    shown = ranked.join(asked_by.where("q_noid"), "q", "left")  # few queries, if any, are without an id
    return shown.select(F.when(F.col("q_noid").isNull(), F.col("query_id")).alias("query_id"), "rank", F.when(~F.col("noid"), F.col("vec_id")).alias("vec_id"), "score")
