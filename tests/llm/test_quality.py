import math

from bazaarlens.llm import quality as Q


def test_ordered_and_separates():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        g = int(rng.integers(3))
        rows.append((g, sorted({int(x) for x in rng.integers(100, 200, 10)} | ({1} if g == 0 else {2} if g == 2 else set()))))
    known = rows[:400]
    model = Q.fit(np.array([g for g, _ in known]), np.array([len(f) for _, f in known]), np.concatenate([f for _, f in known]))
    assert model.thresholds[0] < model.thresholds[1]
    right = 0
    for g, f in rows[400:]:
        t = model.tails(f)
        assert 0 <= t[1] <= t[0] <= 1
        right += g == int(t[0] >= 0.5) + int(t[1] >= 0.5)
    assert right >= 0.9 * 200


def test_gradient_by_differences():
    import numpy as np

    rng = np.random.default_rng(2)
    for n_grades in (2, 3, 5):
        counts = rng.integers(0, 5, 40)
        place, y, each = rng.integers(0, 7, counts.sum()), rng.integers(0, n_grades, 40), rng.uniform(0.1, 1, 40)
        theta = rng.normal(size=7 + n_grades - 1)
        of = lambda t: Q.objective(t, y, place, counts, each, 0.01, n_grades)  # noqa: B023, E731
        cuts = theta[7] + np.concatenate([[0], np.cumsum(np.exp(theta[8:]))])
        loss = 0.005 * float((theta[:7] ** 2).sum())
        for k, at in enumerate(np.cumsum(counts) - counts):
            s = sum(theta[f] for f in place[at : at + counts[k]])
            upto = [0.0, *(1 / (1 + math.exp(s - c)) for c in cuts), 1.0]
            loss -= each[k] * math.log(upto[y[k] + 1] - upto[y[k]])
        value, grad = of(theta)
        assert math.isclose(value, loss, rel_tol=1e-9)
        for j in range(len(theta)):
            step = np.eye(len(theta))[j] * 1e-6
            assert math.isclose((of(theta + step)[0] - of(theta - step)[0]) / 2e-6, grad[j], rel_tol=1e-4, abs_tol=1e-7)


def test_scores_by_formula(spark, sf):
    """The query against plain Python: its features, one sum, one sigmoid for each threshold."""
    from bazaarlens.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.train(docs, Q.grades(spark.read.parquet(f"{sf}/labels.parquet")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op7_ordinal_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = math.fsum(float(model.weights[f]) for f in Q.features(texts[r.doc_id]))
        tails = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert math.isclose(r.tail_probability, tails[-1], abs_tol=1e-6) and math.isclose(r.expected_grade, sum(tails), abs_tol=1e-6)
        assert r.keep == (r.tail_probability >= Q.CUTOFF)


def test_held_out_accuracy(spark):
    """Fitted on four fifths of the rated documents of a table, judged on the rest."""
    d = "/root/testdata/sf0.1"
    docs, rated = spark.read.parquet(f"{d}/documents.parquet"), Q.grades(spark.read.parquet(f"{d}/labels.parquet"))
    model = Q.train(docs, rated.where("doc_id % 5 <> 0"))
    rows = Q.score(docs, model).join(rated.where("doc_id % 5 = 0"), "doc_id").collect()
    kept = {g: [r.keep for r in rows if r.grade == g] for g in range(3)}
    assert sum(kept[2]) >= 0.97 * len(kept[2])
    assert sum(kept[0]) <= 0.1 * len(kept[0])
    mean = [sum(r.expected_grade for r in rows if r.grade == g) / len(kept[g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, 0) for i, t in enumerate([None, "", "good words here " * 30, "x", "bad!! BAD!! %%%", "bad!! BAD!! %%%", "w" * 50_000])], "doc_id long, text string, keep int")
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 0), (4, 1, 1), (None, 1, 0), (0, None, 0), (1, 1, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in Q.grades(labels).collect()} == {2: 2, 4: 0, 99: 2}
    for lab in (labels, labels.limit(0)):
        model = Q.train(docs, Q.grades(lab))
        rows = Q.score(docs, model).collect()
        assert len(rows) == 7 and (lab is labels) == (model is not None)
        kept = Q.kept(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in rows)
    assert Q.score(docs.limit(0), model).count() == 0


def test_features_are_bounded(spark):
    """The driver gets a bounded sum of features, whatever the texts' length; a huge row doesn't displace others."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(60)] + [(60 + i, " ".join(f"long{i}x{k}" for k in range(20_000))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 3) for i in range(64)], "doc_id long, grade int")
    found = {r.doc_id: len(r.features) for r in Q.rated_features(docs, rated, of_one=10_000).collect()}
    assert sorted(found) == list(range(60))
    some = {r.doc_id: len(r.features) for r in Q.rated_features(docs, rated, most_features=4000, of_one=1000).collect()}
    assert 5 < len(some) < 60 and sum(some.values()) <= 4000 and some.items() <= found.items()
    assert sorted(r.doc_id for r in Q.rated_features(docs, rated).collect()) == list(range(64))


def test_long_tokens_are_not_remembered():
    before = Q._remembered.cache_info().currsize
    for k in range(50):
        Q.features(f"{k}" + "x" * 5000)
    assert Q._remembered.cache_info().currsize == before
    assert Q.features("Wordy!") == [*set(Q._hashes("Wordy!")), *Q.features("Wordy!")[-7 * Q.SHAPE :]]


def test_fit_takes_features_in_blocks(monkeypatch):
    """The driver holds no array of doubles for all features, and blocks change nothing but the last digits."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 2000, 4000)
    found = rng.integers(0, 50_000, counts.sum()).astype(np.int32)
    grade = rng.integers(0, 3, len(counts))
    tracemalloc.start()
    model = Q.fit(grade, counts, found, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 18 * len(found)
    monkeypatch.setattr(Q, "BLOCK", 1000)
    small = Q.fit(grade[:300], counts[:300], found[: counts[:300].sum()], rounds=5)
    monkeypatch.setattr(Q, "BLOCK", 1 << 30)
    whole = Q.fit(grade[:300], counts[:300], found[: counts[:300].sum()], rounds=5)
    assert np.allclose(small.weights, whole.weights, atol=1e-6) and np.allclose(small.thresholds, whole.thresholds)
    assert model.weights.any()
