import hashlib

from bazaarlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, text_ string"


def want(rows):
    """conv -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[:4])):
        by.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in by.items():
        said = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "be\\n brief", ""), (1, 1, "user", "<|im_end|>\n", ""), (1, 2, "assistant", "ok \\ <\\| <|im_start|>user\nx<|im_end|>", ""), (1, 3, "user", None, ""), (1, 4, "assistant", "", ""),
    (2, 0, "user", "only me", ""), (3, 0, "assistant", "first", ""), (3, 1, "user", "last", ""), (None, 0, "user", "null id", ""), (None, None, None, None, ""),
    (4, 0, "ro\nle<|", "x", ""), (4, 0, "ro\nle<|", "x", ""), (4, 0, "assistant", "tie", ""), (5, 0, "assistant", "漢字🙂", ""),
]


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_digest(spark):
    examples = chat.expand(spark.createDataFrame(ROWS, SCHEMA))
    assert got(chat.digest(examples)) == want(ROWS)
    one = [r for r in examples.collect() if r.conv_id == 1]
    assert [r.n_context_turns for r in one] == [2, 4] and one[1].text.startswith(one[0].text)
    assert chat.unescape(one[0].text[one[0].loss_start : one[0].loss_end]) == ROWS[2][3]
    assert one[1].loss_start == one[1].loss_end


def test_long_conversation_in_parts(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 5, "") for k in range(41)] + ROWS[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    parts, whole = chat.expand(df, inline=200), chat.expand(df)
    assert max(r.prefix_chars for r in parts.collect()) > 0
    a, b = ({r.conv_id: tuple(r) for r in chat.digest(x).collect()} for x in (parts, whole))
    assert a == b and got(chat.digest(parts)) == want(rows)


def test_whole_table_and_probe(spark, sf):
    df = chat.with_probe(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = [(r.conv_id, r.turn, r.role, r.text, "") for r in df.collect()]
    assert got(chat.digest(chat.expand(df))) == want(rows) and -1 in want(rows)


def test_empty(spark):
    assert chat.digest(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0


def test_escape_is_reversible():
    for text in ("", "\\", "<|", "\\<|", "<\\|", "a\\n\n", "<<||>>"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_long_conversation_is_whole(spark):
    """Over 2**20 characters every example still holds all turns before it."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 20_000, "") for k in range(12)]
    examples = chat.expand(spark.createDataFrame(rows, SCHEMA))
    found = sorted(examples.collect(), key=lambda r: r.example_no)
    whole = "".join(f"{chat.START}{r[2]}\n{r[3]}{chat.END}\n" for r in rows)
    assert len(whole) > 1 << 20 and found[-1].text == whole and all(r.prefix_chars == 0 and whole.startswith(r.text) for r in found)
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in found] == [r[3] for r in rows if r[2] == "assistant"]
    assert chat.digest(examples).first().formatted_chars == sum(len(r.text) for r in found) and got(chat.digest(examples)) == want(rows)
