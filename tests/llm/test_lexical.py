"""Operator 13 against plain Python."""

import random
import re

import pytest

from bazaarlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def brute(docs, items, limit):
    found = [(i, words(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in queries.items():
        weights = {t: lexical.weight(n_docs, sum(t in w for _, w in found)) for t in terms}
        scores = []
        for ident, w in found:
            m = 50 + (50 * len(w) * n_docs) // n_words if w else 0
            score = sum(weights[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if score > 0:
                scores.append((-score, ident is None, ident or 0))
        out += [(item, k + 1, None if null else ident, -score) for k, (score, null, ident) in enumerate(sorted(scores)[:limit])]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, term string, rank int").repartition(3)
    items = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    found = lexical.search(docs, items, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def some(seed, n, length, letters="abcdeéß"):
    rng = random.Random(seed)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 2))) for _ in range(60)] + ["Word", "x-y", "7", "A_B"]
    return [" ".join(rng.choice(made) for _ in range(rng.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize(("block", "limit"), [(1 << 17, 50), (40, 3)])
def test_random_documents(spark, monkeypatch, block, limit):
    monkeypatch.setattr(lexical, "CELLS", 2000)
    docs = [*enumerate(some(1, 150, 60)), (3, "a b c"), (3, "a b c"), (None, "a b c a"), (None, "a b"), (500, None), (501, ""), (502, "-- !!"), (503, "a " * 5000)]
    items = [*enumerate(some(2, 25, 20)), (4, "ab ca again"), (None, "a b éß"), (90, None), (91, "nowhere"), (92, "")]
    assert searched(spark, docs, items, block=block, limit=limit) == brute(docs, items, limit)


def test_long_terms_and_many_ties(spark):
    long = "Ü" * 3000
    docs = [(k, f"same words {long}x") for k in range(300)] + [(k, f"{long}y and more") for k in range(300, 330)]
    items = [(1, f"{long}y"), (2, f"same {long}x"), (3, "more and same")]
    assert searched(spark, docs, items) == brute(docs, items, 50)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []


def test_graph_shares_sums_and_keeps_them():
    rng = random.Random(5)
    common = list(range(12))
    items = [sorted({*common, *rng.sample(range(12, 80), 10)}) for _ in range(30)] + [[5], [0, 1]]
    graph = lexical.Graph(items, 80)
    import numpy as np

    values = np.random.default_rng(1).integers(0, 10**12, (80, 7))
    assert (graph.scores(values) == np.stack([values[i].sum(0) for i in items])).all()
    adds = graph.size - graph.n_terms + len(graph.nodes) - len(items)
    assert adds < 0.6 * sum(len(i) - 1 for i in items)
