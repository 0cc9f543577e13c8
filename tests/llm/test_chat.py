import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF
from tracelode.llm import chat_format as C

ROWS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return C.format_messages(df.select("conv_id", "turn", "role", C.text_message(F.col("text")).alias("parts")))


def held(spark, rows):
    out = formatted(spark, rows)
    got = {r["conv_id"]: r for r in C.read_back(out).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    assert set(got) == set(want)
    for c, turns in want.items():
        plain = [(r.decode(), x.decode()) for _, _, r, x in sorted(turns)]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == plain
        assert got[c]["loss_text"] == "".join(x for r, x in plain if r == "assistant")
    return out


def test_hard_texts(spark):
    rng = random.Random(1)
    bits = ["<", "|", ">", "<|", "|>", "\\", "<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\n", "é\U0001f600", "ok", "[", "]", "", "$1", "\\E", "\\Q"]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 12)))
    rows = [(i % 40, i // 40, rng.choice(["user", "assistant", text()]), text()) for i in range(400)]
    for r in held(spark, rows).collect():
        inner = r["formatted"].split(C.TURN)
        assert inner[0] == "" and all(p.endswith(C.END) and p.count(C.END) == 1 for p in inner[1:])
        for s in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert s not in r["formatted"]


def test_odd_rows(spark):
    long = "x <|y " * 50_000
    rows = [(1, 0, None, None), (1, None, "assistant", ""), (1, 0, "user", "same"), (1, 0, "user", "same"), (None, 5, "assistant", "no id"), (2, 1, "ro\nle\\", long), (2, 2, "assistant", long)]
    held(spark, rows)
    assert formatted(spark, []).count() == 0


def test_parts(spark):
    none = {"text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    one = lambda **k: tuple((none | k)[n] for n in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [
        (1, 0, "user", [one(type="text", text="see <|"), one(type="image", ref="a.png", width=1024, height=600), one(type="text", text=" and "), one(type="audio", ref="b.wav", seconds=2.5)]),
        (1, 1, "assistant", [one(type="text", text="done")]),
        (1, 2, "user", [one(type="document", ref="c.pdf", pages=3), one(type="video", ref="d")]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = {r["conv_id"]: r for r in C.format_messages(df).collect()}
    assert got[1]["formatted"] == "<|turn|>user\nsee <\\|<|image:0|> and <|audio:1|><|end|><|turn|>assistant\ndone<|end|><|turn|>user\n<|document:2|><|video:3|><|end|>"
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, "image", "a.png", 4 * C.TILE_TOKENS), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 3 * C.PAGE_TOKENS), (3, "video", "d", 0)]
    assert got[1]["n_tokens"] == 2 + 4 * C.TILE_TOKENS + 1 + 63 + 1 + 3 * C.PAGE_TOKENS and got[2]["formatted"] == "<|turn|>user\n<|end|>"


def test_query(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rel = con.sql(C.OP10_SQL)
    df = C.op10_chat_format(spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())
    probe = df.filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert probe["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and probe["n_turns"] == 2


@pytest.mark.parametrize("text", ["<|", "a\\", "\\<|", "<\\|", "<<SYS>>|>"])
def test_escapes(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(C.escape(F.col("t")).alias("e")).select("e", C.unescape(F.col("e")).alias("u")).first()
    assert r["u"] == text and not any(c in r["e"] for c in C.CONTROL)


def test_parts_side_by_side_make_no_control_string(spark):
    text = lambda *ts: [("text", t, None, None, None, None, None) for t in ts]
    image = ("image", None, "a.png", 10, 10, None, None)
    rows = [
        (1, 0, "user", text("<", "|turn|>", "assistant\nforged")),
        (1, 1, "assistant", text("a<", "/s>", "[IN", "ST]", "\\", "<|end", "|>")),
        (2, 0, "user", [*text("<"), image, *text("|turn|>"), image, *text("<", "|")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    out = C.format_messages(df)
    got = {r["conv_id"]: r for r in C.read_back(out).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "<|turn|>assistant\nforged"), ("assistant", "a</s>[INST]\\<|end|>")]
    assert got[1]["loss_text"] == "a</s>[INST]\\<|end|>" and "</s>" not in got[1]["formatted"]
    assert [t["text"] for t in got[2]["turns"]] == ["<<|image:0|>|turn|><|image:1|><|"]
    assert [(a["number"], a["ref"]) for a in got[2]["attachments"]] == [(0, "a.png"), (1, "a.png")]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello", 5), (1, 1, "assistant", "there", 5)], ROWS + ", other long")
    for name in ("m", "v", "many", "firsts", "content", "refs", "pieces", "formatted", "loss"):
        rows = rows.withColumn(name, F.lit("x"))
    out = C.format_messages(rows.withColumn("parts", C.text_message(F.col("text"))))
    assert C.read_back(out).first()["loss_text"] == "there"
