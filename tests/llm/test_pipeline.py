import hashlib
import importlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from bazaarlens.llm import bpe, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "repeated strings", "source mix", "byte-level BPE"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{k}")
        after = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns
        assert after.count() > 0
        if name in ("quality classifier", "near duplicates"):
            assert after.count() < before
        if name == "repeated strings":
            assert after.count() == before
        docs, before = after, after.count()
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)


def fair_queue(rows, weights=(3, 1, 2), budget=1.5, epochs=2):
    """Weighted fair queueing in plain Python: ``rows`` of (mark, id, source, size) to how often each is taken."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[3] for r in rows if r[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, left, open_ = {}, budget * sum(size.values()), list(sources)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if epochs * size[s] <= share * weight[s]]
        target.update({s: epochs * size[s] if full else share * weight[s] for s in full or open_})
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    queue = []
    for s in sources:
        upto = 0
        for epoch in range(epochs):
            for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: rows[k][:2]):
                upto += rows[k][3]
                if target[s]:
                    queue.append((upto / target[s], s is None, s or "", rows[k][1], rows[k][3], epoch, k))
    taken, total = Counter(), 0
    for *_, words, _, k in sorted(queue):
        total += words
        if total <= int(budget * sum(size.values())):
            taken[k] += 1
    return taken


def near_groups(rows, threshold):
    """Smallest id of each row's group by comparing all pairs of 5-word shingle sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= threshold * len(sets[i] | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    return up


def cut_by_hand(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for text, d in zip(texts, data):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        # a character goes if all its bytes go
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append(text if text is None else "".join(kept))
    return out


def test_stages_by_hand(spark, sf):
    """Each stage's rows against plain Python, on a whole table and rows with nulls and copies."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = [r for r in docs.collect()][:60]
    odd = [(None, some[3].text, "en", some[3].source, 1), (None, None, None, None, None), (10**6, "", "en", None, 0), (None, "é" * 250 + some[7].text, "fr", "own", 9), (10**6 + 1, some[9].text, "en", None, 3)]
    docs = spark.createDataFrame([*map(tuple, docs.collect()), *odd], schema)

    model = quality.train(docs, quality.grades(spark.read.parquet(f"{sf}/labels.parquet")))
    tail = lambda t: 1 / (1 + math.exp(model.thresholds[-1] - math.fsum(float(model.weights[f]) for f in quality.features(t))))
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in corpus_pipeline.keep_quality(spark, docs, sf).collect()]
    assert Counter(got) == Counter(r for r in rows if tail(r[1]) >= quality.CUTOFF)

    rows = got + [tuple(r) for r in odd]
    docs = spark.createDataFrame(rows, schema)
    up = near_groups([r[:2] for r in rows], 80)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    least, wordless = {}, [r for r in rows if not (r[1] or "").split()]
    for k, r in enumerate(rows):
        if r not in wordless:
            least.setdefault(up[k], []).append(r)
    with_id = [min((r for r in of if r[0] is not None), default=None, key=lambda r: r[0]) for of in least.values()]
    assert Counter(r for r in got if r not in wordless and r[0] is not None) == Counter(r for r in with_id if r)
    assert sum(r not in wordless and r[0] is None for r in got) == sum(r is None for r in with_id)
    assert Counter(r for r in got if r in wordless) == Counter(set(r for r in wordless if r[0] is not None)) + Counter(r for r in wordless if r[0] is None)

    rows = got + [(5 * 10**6 + k, f"before {k} " + some[k].text[:900] + "é", "en", "hot", 1) for k in range(0, 40, 2)]
    docs = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in corpus_pipeline.cut_repeats(spark, docs, sf).collect()]
    want = cut_by_hand([r[1] for r in rows])
    assert Counter(got) == Counter((r[0], t, r[2], r[3], len(t or "")) for r, t in zip(rows, want))

    rows = got + got[:3]
    docs = spark.createDataFrame(rows, schema)
    hashes = docs.select("*", F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit("b"), *docs.columns).alias("b")).collect()
    sized = [(hashlib.md5(f"11:{'' if r.doc_id is None else r.doc_id}:{r.a}:{r.b}".encode()).hexdigest(), -1 if r.doc_id is None else r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in hashes]
    taken = fair_queue(sized)
    want = Counter()
    for k, r in enumerate(hashes):
        want[tuple(r)[:-2]] += taken[k]
    assert Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, sf).collect()) == +want

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    got = corpus_pipeline.encode(spark, docs, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == Counter((r[0], tuple(library.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


def test_odd_rows(spark, sf):
    """Nulls, empty texts, repeats, extra columns with names like the internal ones, a very long text."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "word and word " * 90_000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *[f"'mine' AS {c}" for c in ("sig", "n", "kept", "key", "th", "spans", "rest", "h", "size", "copies", "row", "shard", "ids", "keep", "component_id")])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() >= (0 if k == 0 else 1)
        assert k == 4 or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert set(entry.oracle_sql()) <= set(names)


def test_similar_from_80(spark, sf):
    """Five-word shingles: of 100 shingles each, texts share 90 (0.82) or 88 (0.79)."""
    words = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    base, other = words("w", 104), words("v", 104)
    texts = [base, base[:94] + words("x", 10), other, other[:92] + words("y", 12)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()) == [0, 2, 3]


def test_chance_of_a_miss():
    from math import comb

    from bazaarlens.llm import near_dup

    for threshold in (80, 85):
        m, p = round(64 * near_dup.least_shared(threshold)), threshold / 100
        below = lambda m: sum(comb(64, j) * p**j * (1 - p) ** (64 - j) for j in range(m))
        assert below(m) <= 1e-7 < below(m + 1)
