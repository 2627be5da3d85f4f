"""Operator 3: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its text the only
part under the loss mask. Turns after the last assistant turn (or all turns, if there is none) become
one more example without a target, so that nothing of a conversation is lost. The template is
``<|im_start|>role\\ntext<|im_end|>\\n``; in roles and texts ``\\`` becomes ``\\\\``, ``<|`` becomes
``<\\|`` and, in roles, a line end becomes ``\\n``, which ``unescape`` reverses, so no text can hold
a control string.

Rows are dealt by conversation, sorted by turn and read as a stream. Every example holds its whole
text, however long the conversation is, so output grows with the square of a conversation's turns. A
worker holds one conversation's formatted text and a batch of examples, of one example if it is long.

Defined results: a null text is empty, a null role is the empty role; rows are ordered by turn
(null first), then role and text, and repeated rows are repeated turns; a null conv_id is one more
conversation; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"

EXAMPLES = "conv_id long, example_no int, n_context_turns int, prefix_chars long, text string, loss_start long, loss_end long"
_EXAMPLES = pa.schema(
    [("conv_id", pa.int64()), ("example_no", pa.int32()), ("n_context_turns", pa.int32()), ("prefix_chars", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 512, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(part) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns))


def _expanded(rows: Iterator[tuple], inline: int | None) -> Iterator[tuple]:
    """Examples of turns (conv_id, role, text) that come in order. ``kept`` pieces follow the text of
    the last example; ``full`` is that text while the conversation is short."""
    now, any_row = None, False
    number = turns = sent = 0
    full: str | None = ""
    kept: list[str] = []

    def rest() -> Iterator[tuple]:
        if any_row and kept:
            text = "".join(kept)
            yield (now, number, turns, 0, full + text, None, None) if full is not None else (now, number, turns, sent, text, None, None)

    for conv, role, text in rows:
        if not any_row or conv != now:
            yield from rest()
            now, any_row, number, turns, sent, full, kept = conv, True, 0, 0, 0, "", []
        head = f"{START}{escape_role(role or '')}\n"
        body = escape(text or "")
        if role == TARGET_ROLE:
            before = "".join(kept) + head
            piece = f"{before}{body}{END}\n"
            if full is not None and (inline is None or sent + len(piece) <= inline):
                full += piece
                at = sent + len(before)
                yield now, number, turns, 0, full, at, at + len(body)
            else:
                full = None
                yield now, number, turns, sent, piece, len(before), len(before) + len(body)
            number, sent, kept = number + 1, sent + len(piece), []
        else:
            kept.append(f"{head}{body}{END}\n")
        turns += 1
    yield from rest()


def expand(conversations: DataFrame, inline: int | None = None) -> DataFrame:
    """One row for each example: its number in the conversation, turns of context, text and where in
    ``text`` the loss mask lies (null without a target). ``prefix_chars`` is 0. Only if a caller asks for
    it by ``inline``, a conversation of more characters is given in parts: ``prefix_chars`` is then the
    number of characters that come before ``text`` and are the whole text of the example before."""
    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda b: _batches(_expanded(_rows(b), inline), _EXAMPLES), EXAMPLES)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def _digested(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Reads examples back; those of a conversation follow each other. What an example repeats of the
    one before must equal it; only the new part is digested."""
    now, any_row, covered, before = None, False, 0, ""
    all_turns = loss = None
    n_turns = loss_chars = chars = examples = 0
    for conv, number, _, prefix, text, start, end in rows:
        if not any_row or conv != now or number == 0:
            if any_row:
                yield now, n_turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, examples
            now, any_row, covered, before = conv, True, 0, ""
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = examples = 0
        if prefix:
            if prefix != covered:
                raise ValueError(f"an example of conversation {conv} is missing")
            new, whole = text, prefix + len(text)
        else:
            if not text.startswith(before):
                raise ValueError(f"an example of conversation {conv} has another context than the one before")
            new, whole, before = text[covered:], len(text), text
        at = 0
        for m in _TURN.finditer(new):
            if m.start() != at:
                raise ValueError(f"an example of conversation {conv} can't be read")
            at = m.end()
            all_turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            n_turns += 1
        if at != len(new):
            raise ValueError(f"an example of conversation {conv} can't be read")
        if start is not None:
            said = unescape(text[start:end])
            loss.update(said.encode())
            loss_chars += len(said)
        covered, chars, examples = whole, chars + whole, examples + 1
    if any_row:
        yield now, n_turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, examples


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of ``expand`` say, read from their texts and masks, for each conversation.
    ``formatted_chars`` counts the whole text of every example."""
    return examples.mapInArrow(lambda b: _batches(_digested(_rows(b)), _DIGEST), DIGEST)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts are control strings."""
    said = f"{END}{START}assistant ok"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
