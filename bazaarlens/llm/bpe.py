"""Operator 10: byte-level BPE encoding and decoding through a sentencepiece model.

The model is not trained: its protocol buffer is written straight from a rank file. Each token's
bytes become one printable character per byte (the usual byte alphabet), scored by the negative
rank, with identity normalisation. Sentencepiece then merges the best-scored adjacent pair first,
which is the merge of the lowest rank. A text is cut by the pre-token pattern, each pre-token is
encoded separately, and decoding maps each piece's characters back to bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; ``doc_id`` is passed
through (null included); repeated rows give repeated rows; other columns are ignored; an empty
table gives an empty table; texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_rows

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pre-tokens that a worker remembers, about, and the longest one; a full memory is emptied. Results do not
#: depend on either.
REMEMBERED, LONGEST = 64 << 20, 256


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of BPE type whose piece ids are the ranks (which must be 0..n-1)."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0 to n - 1")
    letters = byte_alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("".join(letters[b] for b in t), -float(i), 1) for i, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


class Codec:
    """Encodes and decodes whole texts; one per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.letters = byte_alphabet()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(ranks))
        value = {c: b for b, c in enumerate(self.letters)}
        self.bytes_of = [bytes(value[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.digits_of = [str(i) for i in range(len(ranks))]
        self.cut = regex.compile(pattern).findall
        self.known = _Remembered(self._pre_token)

    def _pre_token(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        ids = tuple(self.model.encode("".join([self.letters[b] for b in data])))
        if len(ids) > 1 and (whole := self.ranks.get(data)) is not None:
            return (whole,)  # a token that merges don't reach stands for itself
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.cut(text)))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digits(self, ids: list[int]) -> str:
        return ",".join(map(self.digits_of.__getitem__, ids))


class _Remembered(dict):
    def __init__(self, make):
        self.make, self.held = make, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            # about what a string, a tuple and their entry take
            self.held += 250 + 4 * len(key) + 8 * len(value)
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self[key] = value
        return value


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    found = map_rows(docs, [id_col, text_col], lambda i, t: (i, codec(path).encode(t)), "id long, ids array<int>", out)
    return found.withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, data binary)``; null ids decode to no bytes."""
    out = pa.schema([("id", pa.int64()), ("data", pa.binary())])
    found = map_rows(ids, [id_col, ids_col], lambda i, x: (i, codec(path).decode(x or [])), "id long, data binary", out)
    return found.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again and digest both in the task; ``with_ids`` also returns the ids."""

    def row(i: int, text: str | None) -> tuple:
        own = codec(path)
        ids = own.encode(text)
        found = i, len(ids), hashlib.sha256(own.digits(ids).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()
        return (*found, ids) if with_ids else found

    out = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs, [id_col, text_col], row, schema, pa.schema(out)).withColumnRenamed("id", id_col)
