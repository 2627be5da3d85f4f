"""Operator 12: the machines by their optimum, held-out accuracy, and odd rows."""

import zlib

import numpy as np

from bazaarlens.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert len(held) > 20 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97


SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog and then it goes to the house with that thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und geht dann nach hause mit dem ding",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et rentre à la maison avec cette chose",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego vuelve a la casa con esa cosa",
    "xx": "zzkr vrrt qqlp zzkr mmnt qqlp vrrt zzkr",
}


def rows():
    out, rng = [], np.random.default_rng(2)
    for lang, text in SENTENCES.items():
        words = text.split()
        out += [(len(out) + k, " ".join(rng.choice(words, 12)), lang, 0.5, "s") for k in range(40)]
    return out


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, score double, lang_pred string")


def test_families_pairs_and_odd_rows(spark):
    odd = [(None, "the quick dog and the house", "en", 0.0, ""), (None, "der hund und das haus", None, 0.0, ""), (1001, None, "de", 0.0, ""), (1002, "", "de", 0.0, ""), (1003, "12 34 !!", "fr", 0.0, ""),
           (1004, "le chien rentre à la maison " * 60000, None, 0.0, ""), (1005, "le chien", "fr", 0.0, ""), (1005, "le chien", "fr", 0.0, ""), (1005, "el perro", "es", 0.0, "")]
    docs = table(spark, rows() + odd)
    model = langid.train(docs)
    assert model.families == ["Germanic", "Romance", "of xx"] and model.langs["Romance"] == ["es", "fr"]
    found = langid.predict(docs, model).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(rows()) + len(odd)
    assert np.mean([by[i][0].lang_pred == lang for i, _, lang, *_ in rows()]) > 0.98
    assert all(r.held_out for r in by[None]) and sorted(r.lang_pred for r in by[None]) == ["de", "en"]
    assert [(r.lang_pred, r.score) for i in (1001, 1002, 1003) for r in by[i]] == [("und", 0.0)] * 3
    assert by[1004][0].lang_pred == "fr" and len(by[1005]) == 3
    again = langid.predict(docs.repartition(7), langid.train(docs.repartition(5))).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_only_learned_rows_count(spark):
    """Held-out rows, and columns other than the text, change nothing."""
    data = rows()
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s, "other") for i, t, lang, s, _ in data]
    a, b = (langid.predict(table(spark, data), langid.train(table(spark, d))).collect() for d in (data, swapped))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_nothing_or_one_language_to_learn(spark):
    none = table(spark, [(1, "some words", None, 0.0, "")])
    assert [tuple(r) for r in langid.predict(none, langid.train(none)).collect()] == [(1, False, "und", 0.0)]
    one = table(spark, [(1, "some words", "en", 0.0, ""), (2, "other words", None, 0.0, "")])
    assert {(r.lang_pred, r.score) for r in langid.predict(one, langid.train(one)).collect()} == {("en", 1.0)}
    empty = table(spark, [])
    assert langid.predict(empty, langid.train(empty)).collect() == []


def test_sample_is_bounded_and_balanced(spark):
    data = [(i, f"word{i} the", "en", 0.0, "") for i in range(300)] + [(1000 + i, f"wort{i} der", "de", 0.0, "") for i in range(20)]
    seen = []
    fit, langid.fit = langid.fit, lambda langs, x: seen.append((langs, x.shape)) or fit(langs, x)
    try:
        langid.train(table(spark, data), most=30)
    finally:
        langid.fit = fit
    assert seen[0][1] == (30, langid.DIM + 1) and 13 <= seen[0][0].count("de") <= 17


def test_machine_reaches_the_optimum():
    """The hinge loss of the weights against subgradient steps from many starts."""
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(60, 3)), np.ones((60, 1))]).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0.2, 1.0, -1.0)
    each = 4.0 * 60 / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())

    def loss(w):
        return 0.5 * w @ w + (each * np.maximum(0, 1 - y * (x @ w))).sum()

    w = langid.svm(x, y, epochs=20000, least=1e-9)
    assert all(loss(w) <= loss(w + rng.normal(size=4) * s) + 1e-3 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_pieces_change_nothing(monkeypatch):
    text = "Größe und Länge, " * 500
    whole = langid.vector(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert np.array_equal(whole, langid.vector(text))
