"""Operator 11 against a trie of plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from bazaarlens.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, digest string, k long"


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def brute(rows, rebuilt):
    own = {}
    for c, turn, role, text, *_ in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def place(t):
        return *t[:3], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()[:16]

    own = {c: [t[2:] for t in sorted(ts, key=place)] for c, ts in own.items()}
    made = dict(own)
    if rebuilt:
        for c, ts in own.items():
            if c is not None:
                h = zlib.crc32(str(c).encode()) % 9
                base = c - (c % 5 if c >= 0 else -(-c % 5))
                made[c] = own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for key, ids in members.items():
        below = [x for x in members if x[: len(key)] == key]
        kids = {x: sum(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below}
        ends = sorted(c for c in ids if c is not None and len(made[c]) == len(key))
        out.append((
            least(ids), len(key), least(members[key[:-1]]) if key else None, len(ids), kids[key], sum(n == 0 for n in kids.values()),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def same(found, rows, rebuilt):
    def key(r):
        return tuple((x is not None, x or 0) for x in r[:-1]) + (r[-1],)

    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, rebuilt), key=key)


def some(seed, convs, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, turns)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(texts), "clash", 0))
    return rows


@pytest.mark.parametrize(("cells", "block"), [(1 << 12, 1024), (8, 2), (64, 1)])
def test_random_conversations(spark, cells, block):
    rows = some(cells, [*range(-7, 40), None], 12, ["", "é", "longer text", None])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sizes, turns = pt.with_borrowed_heads(pt.turn_digests(df))
    same(pt.trie(sizes, turns, cells, block), rows, True)
    turns = pt.turn_digests(df)
    same(pt.trie(pt.conversation_sizes(turns), turns, cells, block), rows, False)


def test_turnless_conversations(spark):
    rows = [(c, t, "user", "x", "", 0) for c in (1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13) for t in range(2)]
    sizes, turns = pt.with_borrowed_heads(pt.turn_digests(spark.createDataFrame(rows, SCHEMA)))
    assert sizes.where("size = 0").count() > 2
    same(pt.trie(sizes, turns), rows, True)


def test_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 7)
    rows = [(c, t, "user", f"common {t}", "", 0) for c in range(0, 300, 5) for t in range(3)] + [(c, t, "assistant", f"long {t % 9}" * (t % 3), "", 0) for c in (7, 8) for t in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = pt.turn_digests(df)
    same(pt.trie(pt.conversation_sizes(turns), turns, block=16), rows, False)


def test_one_conversation_in_several_parts(spark):
    rows = [(c, None if c else t, "u", "same" if c else f"{t}", "", 0) for c in (None, 0, 1) for t in range(400)]
    turns = pt.turn_digests(spark.createDataFrame(rows, SCHEMA).repartition(9))
    found = turns.groupBy("conv_id").agg({"k": "max", "*": "count"}).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in found) == sorted((c or -1, 400, 400) for c in (None, 0, 1))
    assert turns.select("conv_id", "k").distinct().count() == 1200


def test_empty_table(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
