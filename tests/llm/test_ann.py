import math
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import ann


def brute(rows, queries, limit):
    """The nearest of each query row among all rows but itself."""
    out = {}
    for q, v in queries:
        own = rows.index((q, v))
        scored = sorted((-float(np.add.reduce(np.array(v) * np.array(x))), i) for k, (i, x) in enumerate(rows) if k != own and len(x) == len(v))
        out[q] = [(i, -s) for s, i in scored[:limit]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    """With the production parameters, and parts of few rows."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0"), part_rows=300))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, best in got.items():
        assert len(best) == 20 and best == sorted(best, key=lambda x: (-x[1], x[0])) and q not in dict(best)
        assert all(math.isclose(s, float(np.dot(vectors[q], vectors[i])), abs_tol=1e-12) for i, s in best)


def test_clusters_are_found_in_few_buckets():
    """Where vectors have near neighbours, a query scores under a tenth of all rows, with a recall over 0.9."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 64))
    x = (centres[:, None] + 0.2 * rng.normal(size=(300, 60, 64))).reshape(-1, 64)
    x *= rng.uniform(0.97, 1.0, (18000, 1)) / np.sqrt((x * x).sum(1))[:, None]
    own = ann.Index(len(x), float(np.sqrt((x * x).sum(1)).max()), x[rng.choice(len(x), ann.SAMPLE, replace=False)])
    q = x[::200]
    near, least = own.nearness(q)
    candidates = np.zeros((len(q), len(x)), bool)
    for t in range(own.tables):
        cell = own.cells(x, t)
        who, cells = own.visited(q, near, t)
        for k in range(len(q)):
            candidates[k] |= np.isin(cell, cells[who == k])
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(0, len(x), 200)] = -np.inf
    top = np.argsort(-scores, axis=1)[:, :20]
    assert (np.take_along_axis(scores, top, 1)[:, -1] >= least).all()
    recall, scored = np.take_along_axis(candidates, top, 1).mean(), candidates.mean()
    assert recall > 0.9 and scored < 0.1


def test_large_buckets_are_split(spark):
    """Many near copies of one vector: their bucket has more rows than a part."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=8)
    rows = [(i, (base + 1e-6 * rng.normal(size=8)).tolist()) for i in range(300)] + [(300 + i, rng.normal(size=8).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0"), part_rows=50))
    assert {q: b for q, b in got.items() if q < 300} == {q: b for q, b in want.items() if q < 300}
    assert all(len(b) == 20 for b in got.values())


def test_equal_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 4)).round(1)
    rows = [(i, base[i % 30].tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.nearest(df, df.where("vec_id % 20 = 0"), limit=7, part_rows=40, recall=1.0)) == brute(rows, [r for r in rows if r[0] % 20 == 0], 7)


def test_rows_that_take_no_part(spark):
    good = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [0.0, 0.0]), (9, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "'x' as block")
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0")))
    assert got == {20: [(2, 1.0), (3, 1.0), (3, 1.0), (1, 0.5)]}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0


def test_null_ids_are_candidates(spark):
    """They rank after all ids where scores tie, even after the largest."""
    most = 2**63 - 1
    rows = [(20, [1.0, 0.0]), (None, [0.5, 1.0]), (7, [0.5, -1.0]), (None, [0.9, 0.1]), (None, [0.9, 0.2]), (most, [0.9, 0.3]), (most - 1, [0.4, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.nearest(df, df.where("vec_id % 20 = 0"))) == {20: [(most, 0.9), (None, 0.9), (None, 0.9), (7, 0.5), (None, 0.5), (most - 1, 0.4)]}
    own = ann.nearest(df, df.where("vec_id is null"), limit=1).collect()
    assert sorted((r.query_id is None, r.rank, r.vec_id) for r in own) == [(True, 1, 20), (True, 1, 20), (True, 1, 20)] or len(own) == 3


def test_recall_of_a_million_even_vectors():
    """By the index alone, with the production parameters: no number of probes stops a query short of its chance."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1_000_000, 64)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    index = ann.Index(len(x), 1.0, x[rng.choice(len(x), ann.SAMPLE, replace=False)].astype(float))
    asked = np.arange(0, len(x), 25_000)
    q = x[asked].astype(float)
    near, _ = index.nearness(q)
    scores = q.astype(np.float32) @ x.T
    scores[np.arange(len(q)), asked] = -np.inf
    top = np.argpartition(-scores, 20, axis=1)[:, :20]
    hit = np.zeros(top.shape, bool)
    for t in range(index.tables):
        who, cells = index.visited(q, near, t)
        for k in range(len(q)):
            hit[k] |= np.isin(index.cells(x[top[k]].astype(float), t), cells[who == k])
    assert hit.mean() >= 0.9


def test_repeated_ids_and_two_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 40, rng.normal(size=16).tolist()) for k in range(80)] + [(100 + k, rng.normal(size=5).tolist()) for k in range(30)]
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id in (7, 20, 100, 110)"), recall=1.0).collect()
    by_score = Counter((r.query_id, r.vec_id, round(r.score, 9)) for r in got)
    want = Counter()
    for q in [r for r in rows if r[0] in (7, 20, 100, 110)]:
        want.update((q[0], i, round(s, 9)) for i, s in brute(rows, [q], 20)[q[0]])
    assert by_score == want


def test_small_tables_give_all(spark):
    """With the production parameters: all others if they are fewer than 20, else 20."""
    rng = np.random.default_rng(3)
    for n in (2, 15, 25, 60):
        rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 64)))]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = found(ann.nearest(df, df.where("vec_id % 5 = 0")))
        want = brute(rows, [r for r in rows if r[0] % 5 == 0], 20)
        assert {q: len(b) for q, b in got.items()} == {q: len(b) for q, b in want.items()}
        if n <= 20:
            assert {q: [i for i, _ in b] for q, b in got.items()} == {q: [i for i, _ in b] for q, b in want.items()}
