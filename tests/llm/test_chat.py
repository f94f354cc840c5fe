import hashlib
import random

from pyspark.sql import functions as F

from bytegrams.llm import chat
from bytegrams.llm.queries import op2_chat_format

PARTS = [("text", "see </s> \\ ", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", None), ("text", None, None, None), ("document", "ignored", "c.pdf", 2), (None, "no type", None, None)]


def test_round_trip(spark):
    rng = random.Random(9)
    bits = ["<", "|", ">", "\\", "turn", "<|turn|>", "<|end|>", "<|text|>", "</s>", "[INST]", "[/INST]", "<|image|>", "\n", "é😀", " ", "<|", "[", "<\\|turn|>", "\\\\"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    rows = [(rng.randrange(12), k, rng.choice(["user", "assistant", text()]), text()) for k in range(300)]
    rows += [(50, 1, "assistant", None), (50, None, None, "first"), (51, 0, "user", ""), (None, 0, "assistant", "of nobody"), (52, 3, "user", "b"), (52, 3, "user", "a"), (52, 3, "user", "a")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, rows int").repartition(3)
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    want = {}
    for c, turn, role, t in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", t or ""))
    assert set(got) == set(want)
    for c, said in want.items():
        assert [tuple(x) for x in got[c].turns] == said
        assert got[c].loss_text == "".join(t for r, t in said if r == "assistant")
    whole = chat.format_chat(turns).filter("conv_id = 50").first()
    assert whole.formatted == "<|turn|><|text|>first<|end|><|turn|>assistant<|text|><|end|>"
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_parts(spark):
    turns = spark.createDataFrame([(1, 0, "user", PARTS), (1, 1, "assistant", None), (1, 2, "assistant", [("text", "<s>", None, None)])], f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}")
    row = chat.format_chat(turns).first()
    assert row.formatted == "<|turn|>user<|text|>see <\\/s> \\\\ <|image|><|audio|><|document|>no type<|end|><|turn|>assistant<|text|><|end|><|turn|>assistant<|text|><\\s><|end|>"
    assert [tuple(a) for a in row.attachments] == [(0, 1, "image", "a.png", 768), (0, 2, "audio", "b.wav", 25), (0, 4, "document", "c.pdf", 1024)]
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == ["", "<\\s>"]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in op2_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(want)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, said in want.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), digest(loss))
    assert spark.createDataFrame([("a",)], "text string").select(chat.unescape(chat.escape(F.col("text"), chat.ChatTemplate()))).first()[0] == "a"
