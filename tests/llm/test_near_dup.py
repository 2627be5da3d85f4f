import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import near_dup as N
from bazaarlens.plans.components import connected_components

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            same = len(sets[i] & sets[j])
            if i < j and same and 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(rnd, words, n, changes):
    base = [rnd.choice(words) for _ in range(rnd.randint(6, 120))]
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, changes)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        yield " ".join(own)


@pytest.mark.parametrize("seed", [48, 3])
def test_families(spark, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = [t for _ in range(12) for t in family(rnd, words, rnd.randint(1, 9), 3)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30))) for _ in range(14)]
    texts += ["A b C d", "a B c D", "one", "One", "one two", "", None, " \t ", "É a b c d", "é a b c d"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sig string, n int")
    assert got(N.near_duplicates(docs)) == brute(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(N.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chain(spark):
    """Neighbours are linked, ends are not; all are one component."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 200])) for k in range(8)]
    want = brute(rows)
    assert {c for _, c in want.values()} == {0}
    assert got(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_odd_rows(spark):
    """Null ids are linked like others; an id with several texts connects what each is linked to."""
    alike = [f"n{k}" for k in range(60)]
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text with words"), (7, "quite another text with words"), (None, "a b c d e f"), (None, None), (None, ""), (9, None), (5, "third text of the id"), (4, "third text of the id")]
    rows += [(None, "only null ids here too"), (None, "only null ids here too"), (None, "Only NULL ids here too"), (None, " ".join(alike)), (None, " ".join(alike[:-1])), (None, " ".join(alike[:-1])), (11, "x y z")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    out = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs).collect())
    known = Counter([(5, 2, 4, False), (5, 2, 4, False), (5, 1, 4, False), (7, 1, 4, False), (None, 2, 4, False), (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True), (5, 1, 4, False), (4, 1, 4, True), (11, 1, 11, True)])
    assert out - known == Counter(x for x in out.elements() if x[0] is None and x[2] is None and x[1])
    assert out & known == known
    assert out[None, 1, None, True] == 1 and out[None, 1, None, False] == 2
    nulls = [x for x in out.elements() if x[0] is None and x[1] > 50]
    assert len(nulls) == 3 and {x[2] for x in nulls} == {None} and sum(x[3] for x in nulls) == 1
    kept = [(r.doc_id, r.text) for r in N.kept_documents(docs).collect()]
    assert sorted((i, t or "") for i, t in kept if i is not None) == [(4, "third text of the id"), (9, ""), (11, "x y z")]
    texts = [t for i, t in kept if i is None]
    assert len(texts) == 4 and texts.count(None) == texts.count("") == 1 and sum("null ids" in (t or "").lower() for t in texts) == 1
    assert N.kept_documents(docs).columns == docs.columns
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_links_through_null_ids(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(3, " ".join(words[:200])), (None, " ".join(words[8:208])), (8, " ".join(words[16:216]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in N.near_duplicates(docs).collect()} == {(3, 3), (None, 3), (8, 3)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (103, 101), (7, 7), (None, 5)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 103: 100}


def test_settled_components_take_one_round(spark, monkeypatch):
    from bazaarlens.plans import components

    stored = []
    monkeypatch.setattr(components, "materialize", lambda df, label, f=components.materialize: stored.append(label) or f(df, label))
    stars = spark.createDataFrame([(1, 2), (3, 1), (7, 8)], "src long, dst long")
    assert {tuple(r) for r in connected_components(stars).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert len(stored) == 2
    stored.clear()
    assert connected_components(stars.limit(0)).collect() == [] and len(stored) == 1


def test_rounds_end_with_stars(spark, monkeypatch):
    """A chain that one round makes a star takes one; before, a second round only found that nothing changed."""
    from bazaarlens.plans import components

    stored = []
    monkeypatch.setattr(components, "materialize", lambda df, label, f=components.materialize: stored.append(label) or f(df, label))
    chain = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert {tuple(r) for r in connected_components(chain).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert len(stored) == 2


def test_pairs_of_a_family_that_are_no_links(spark):
    """Sets that meet in rare values and are apart in others: only pairs near the threshold are made, and all links."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(150) > rng.random() / 3], rng.choice(base * np.uint64(3), rng.integers(0, 12))])) for _ in range(120)]
    rows = [(str(k).encode(), k, s.view(np.int64).tolist(), N.parities(s).tolist()) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "sig binary, comp long, items array<long>, bits array<long>")
    made = {tuple(sorted((int(r.a), int(r.b)))) for r in N._apart(df, 80).collect()}
    items = [set(r[2]) for r in rows]
    like = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(items) for j, b in enumerate(items) if i < j}
    links = {p for p, x in like.items() if x >= 0.8}
    assert len(links) > 100 and links <= made
    assert sum(x < 0.7 for x in like.values()) > 1000 and all(like[p] >= 0.7 for p in made)
    differ = lambda i, j: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(rows[i][3], rows[j][3]))
    assert all(differ(i, j) <= len(items[i] ^ items[j]) for i, j in like)
