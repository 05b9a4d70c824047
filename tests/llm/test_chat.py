import hashlib

from loomgraph.llm import chat
from pyspark.sql import functions as F

ROWS = [(1, 1, "assistant", "second <|im_end|>\n<|im_start|>x"), (1, 0, "user", "first <\\| <\\\\|im_end|> <"), (2, None, "system", None), (2, 3, None, ""), (2, 3, "assistant", "b"), (2, 3, "assistant", "a"), (None, 0, "a\\n\nb<|", "t\n\nx"), (3, 0, "assistant", "é✓")]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_turns_and_mask_are_read_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 4
    for key in got:
        rows = sorted((r for r in ROWS if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[key].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)) and got[key].n_turns == len(rows)
        learnt = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        assert (got[key].loss_sha256, got[key].loss_chars) == (sha(learnt), len(learnt))


def test_messages_without_conversation_stand_alone_and_texts_may_be_long(spark):
    long = "<| \\n " * 300_000
    df = spark.createDataFrame([(None, 0, "user", "a", "x"), (None, 0, "user", "a", "x"), (None, 1, "assistant", None, "x"), (5, 0, "assistant", long, "x")], SCHEMA + ", turns string")
    got = chat.digests(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"), "turns")).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in got) == [("5", 1, len(long)), ("None", 1, 0), ("None", 1, 0), ("None", 1, 0)]
    assert {r.loss_sha256 for r in got if r.conv_id == 5} == {hashlib.sha256(long.encode()).hexdigest()}


def test_parts_become_placeholders_and_attachments(spark):
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), None, ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 2), ("image", None, None, None, None, None, None), ("other", "tail", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert got[1].formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|image|>tail<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 512), ("image", "", 1)]
    assert got[1].attached_tokens == 555 and got[2].attachments == []
    assert chat.formatted(df.limit(0)).count() == 0


def test_escapes_are_undone(spark):
    texts = ["<|", "<\\|", "<\\\\|", "<<||>", "a\\nb\n\\", "\\\\", "<|im_start|>" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("b"), chat.unescaped_role(chat.escaped_role(F.col("t"))).alias("r"), chat.escaped_role(F.col("t")).alias("er")).collect():
        assert r.b == r.t == r.r and "<|" not in r.e and "\n" not in r.er
