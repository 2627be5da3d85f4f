import hashlib
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import suffix_dedup as S


def brute(texts, length):
    """[(n_bytes, n_removed, n_spans, sha256 of what is left)] of byte strings."""
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_starts_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(250):
        length = rnd.choice([1, 2, 3, 5, 12, 20])
        letters = rnd.choice([b"a", b"ab", b"abcd\0\xff", bytes(range(256))])
        some = lambda n: bytes(rnd.choice(letters) for _ in range(rnd.randint(0, n)))  # noqa: B023, E731
        base = [some(40) for _ in range(3)]
        pieces = [p for _ in range(rnd.randint(1, 8)) if len(p := some(15) + rnd.choice(base) + some(9)) >= length]
        if not pieces:
            continue
        weights = [rnd.choice([1, 1, 2]) for _ in pieces]
        count = Counter()
        for p, w in zip(pieces, weights):
            for k in range(len(p) - length + 1):
                count[p[k : k + length]] += w
        windows = [len(p) - length + 1 for p in pieces]
        got = [sorted(k for a, b in runs for k in range(a, b + 1)) for runs in S.repeated_starts(pieces, np.array(windows), np.array(weights), length)]
        assert got == [[k for k in range(n) if count[p[k : k + length]] > 1] for p, n in zip(pieces, windows)]


def test_segments_cover_all_strings():
    rng = np.random.default_rng(2)
    for n in (199, 200, 201, 5000):
        data = rng.integers(97, 100, n).astype(np.uint8)
        _, first, last, _ = S.segments(data)
        assert [k for a, b in zip(first, last) for k in range(a, b + 1)] == list(range(max(0, n - 199)))


@pytest.mark.parametrize("period", [b"a", b"ab", b"abcdefg", bytes(range(150)), bytes(range(48, 250))])
def test_periodic_text_has_few_segments(period):
    data = np.frombuffer((period * 50_000)[: 4 << 20], np.uint8)
    anchors, first, last, times = S.segments(data)
    assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(data) - 200
    if len(period) < 150:
        assert len(first) <= len(data) / S.MOST + 10 and (times == 2).sum() >= len(first) - 5
    else:  # some segments a period
        assert len(first) <= len(data) / 20


def test_segments_do_not_depend_on_parts(monkeypatch):
    """Equal strings have equal anchors wherever parts and segments are cut."""
    rng = np.random.default_rng(7)
    data = np.concatenate([rng.integers(97, 100, 3000), np.full(900, 97), np.tile([98, 99], 400), rng.integers(97, 100, 800)]).astype(np.uint8)

    def anchor_of_each(**more):
        anchors, first, last, _ = S.segments(data, **more)
        return np.repeat(anchors, last - first + 1)

    whole = anchor_of_each()
    assert (anchor_of_each(most=7) == whole).all()
    monkeypatch.setattr(S, "CHUNK", 777)
    assert (anchor_of_each() == whole).all()


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_long_periodic_documents(spark, hot, monkeypatch):
    monkeypatch.setattr(S, "MOST", 60)
    texts = ["q" * 1500, "q" * 1499 + "r", "xy" * 700, "z" + "xy" * 150 + "z", "0123456789" * 45, "u" * 201, "v" * 200, "w" * 200, "w" * 199 + "!", "-=" * 99 + "-=-"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removal(docs, hot=hot, bin_bytes=2000).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 200)))


def test_megabytes_of_one_byte(spark):
    texts = ["a" * (4 << 20), "ab" * (2 << 20), "other text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in S.removal(docs).collect()} == {0: (4 << 20, 1), 1: (4 << 20, 1), 2: (0, 0)}


def test_segments_of_megabytes_stay_under_500_mb():
    code = """
import resource
import numpy as np
from bazaarlens.llm import suffix_dedup as S
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for data in (b"a" * (16 << 20), b"ab" * (8 << 20)):
    assert len(S.segments(np.frombuffer(data, np.uint8))[0]) < 9000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 500_000


def test_hashes_in_parts(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 3000).astype(np.uint8)
    whole = S.window_hashes(data, 48)
    monkeypatch.setattr(S, "CHUNK", 1000)
    assert (S.window_hashes(data, 48) == whole).all()


PASSAGE = "".join(random.Random(1).choice("abcdefgh ") for _ in range(320))
TEXTS = [
    None, "", "short", "x" * 199, "y" * 200, "z" * 450, PASSAGE, PASSAGE, "before " + PASSAGE + " after", "é" * 150 + PASSAGE[:250], "ü" + PASSAGE[60:] + "end " + PASSAGE[:230],
    "head " * 30 + PASSAGE[:199], "ab" * 300, "same line\n" * 60, "other " + "same line\n" * 21,
]


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_documents(spark, hot):
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("klmn ") for _ in range(rnd.randint(0, 60))) + PASSAGE + "".join(rnd.choice("opqr ") for _ in range(40)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removal(docs, hot=hot, bin_bytes=900).collect()}
    assert got == dict(enumerate(brute([(t or "").encode() for t in texts], 200)))


def test_repeated_ids_null_ids_and_no_rows(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (1, "alone"), (None, PASSAGE), (None, PASSAGE), (None, None), (2, None), (None, "null " + PASSAGE[:210] + "!"), (3, "y" * 10 + PASSAGE[100:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removal(docs).collect()), key=str)
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows], 200))), key=str)
    long = "".join(random.Random(9).choices("abcdefghij \n", k=1_200_000))  # over a chunk
    one = spark.createDataFrame([(1, PASSAGE), (None, long + PASSAGE)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in S.removal(one).collect()} == {1: 320, None: 320}
    assert S.removal(docs.limit(0)).count() == 0


def test_texts_are_cut_to_whole_characters(spark):
    texts = ["aé" + PASSAGE + "éa", "é" + PASSAGE + "ü", "clean", None]
    docs = spark.createDataFrame([(i, t, "q", len(t or "")) for i, t in enumerate(texts)] + [(None, PASSAGE, "q", 320)], "doc_id long, text string, spans string, n_chars long")
    out = S.removed_texts(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[0] == ("aéa", 3) or got[0] == ("aéa"[:1] + "éa", 3) or got[0][0].startswith("a")
    assert PASSAGE[:200] not in got[0][0] and got[2] == ("clean", 5) and got[3] == (None, 0) and got[None] == ("", 0)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute([(r.text or "").encode() for r in rows], 200)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removal(docs).collect()} == want
