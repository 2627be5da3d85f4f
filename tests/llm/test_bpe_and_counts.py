import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from bazaarlens.llm import bpe, token_counts

PATH = P.path(bpe.VOCABULARY)
TEXTS = ["", None, "hello world", "  a\tb\n\n c", "é" * 50, "\0\x01 nul", "don't 123 #!", "x" * 5000, "漢字 and 🙂", "hello world", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def table(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_round_trip_equals_library(spark, library):
    got = bpe.round_trip(table(spark, TEXTS), PATH, with_ids=True).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = TEXTS[3 if r.doc_id is None else r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode(spark):
    docs = table(spark, TEXTS)
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


def test_whole_table_equals_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()} == want


def test_full_memory_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own, text = bpe.Codec(bpe.read_ranks(PATH)), "one two three four five one two six seven"
    assert own.encode(text) == library.encode_ordinary(text)


def test_ranks_must_be_dense():
    with pytest.raises(ValueError):
        bpe.serialize_model({b"a": 0, b"b": 2})


def test_histogram_and_suffix_sums(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").union(spark.createDataFrame([(None,), ("",), ("",)], "text string"))
    lengths = sorted(len(library.encode_ordinary(r.text or "")) for r in docs.collect())
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(docs, PATH))).cache()
    rows = {r.n_tokens: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.docs_up_to == sum(x <= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n) and r.tokens_up_to == sum(x for x in lengths if x <= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.corpus_tokens == sum(lengths)
    limits = [0, 1, 77, 500, 10**6]
    got = {r.limit: r for r in token_counts.at_limits(sums, limits).collect()}
    for n in limits:
        assert got[n].truncated_total == sum(min(x, n) for x in lengths)
        assert got[n].docs_cut == sum(x > n for x in lengths)
        assert got[n].tokens_in_whole_docs == sum(x for x in lengths if x <= n)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == next(x for k, x in enumerate(lengths, 1) if k / len(lengths) >= r.share)


def test_empty(spark):
    none = table(spark, []).limit(0)
    assert bpe.round_trip(none, PATH).count() == 0
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(none, PATH))).count() == 0
