"""Chat formatting of typed content parts, in DataFrame functions only.

A message is an array of parts (type, text, ref, width, height, seconds, pages). A visitor flattens
the parts of a message in order: text is escaped and stays (parts of text side by side are one text, so that no control string is
made of their ends), an attachment becomes a placeholder
``<|image:N|>``, ``<|audio:N|>`` or ``<|document:N|>`` numbered through the conversation, and its
reference, place and count of expanded tokens are recorded. The template is

    <|turn|>ROLE\\nCONTENT<|end|>

A backslash escapes: in roles and contents each backslash is doubled, and each control string (the
template's own and those of common templates) gets one after its first character, so no control
string is left in a text and one left-to-right pass takes the escapes out again.

The loss mask of a turn is a span of code points of the turn's own piece of the output; turns of the
assistant have their whole content in it. Both, spans and output, are all that ``read_back`` needs.

Defined results: rows are ordered by turn (null first), then role, then text; rows that repeat stay;
a null text is empty, a null role is an empty role; a null conv_id is a conversation like any other;
a part of unknown type is a placeholder of its type's name; other columns are ignored. The text of a
conversation, and its digest, are one value, so a conversation is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of common chat templates; ``<|`` covers those of its kind.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 25, 600
ASSISTANT = "assistant"

_AFTER = {c: "|".join(f"\\Q{s[1:]}\\E" for s in CONTROL if s[0] == c) for c in dict.fromkeys(s[0] for s in CONTROL)}
_BREAK = "|".join(f"(?<=\\Q{c}\\E)(?={rest})" for c, rest in _AFTER.items())


def escape(text: Column) -> Column:
    """Without control strings, reversibly."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _role(text: Column) -> Column:
    """A role escaped, its line breaks too: the first bare one ends it."""
    return F.replace(escape(text), F.lit("\n"), F.lit("\\\n"))


def text_message(text: Column) -> Column:
    """A message of one part of text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _tokens(part: Column) -> Column:
    """Tokens that a part is expanded to: tiles of an image, seconds of audio, pages of a document, words of a text."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    tiles = F.ceil(zero(part["width"]) / TILE) * F.ceil(zero(part["height"]) / TILE)
    return (
        F.when(part["type"] == "image", F.greatest(tiles, F.lit(1)) * TILE_TOKENS)
        .when(part["type"] == "audio", F.ceil(zero(part["seconds"]) * SECOND_TOKENS))
        .when(part["type"] == "document", zero(part["pages"]) * PAGE_TOKENS)
        .otherwise(F.size(F.regexp_extract_all(F.coalesce(part["text"], F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))))
        .cast("long")
    )


def _visit(parts: Column, first: Column) -> Column:
    """(content, attachments, tokens) of a message; ``first``: number of its first attachment."""
    begin = F.struct(
        F.array().cast("array<string>").alias("out"),
        F.array().cast("array<string>").alias("run"),
        F.array().cast("array<struct<number:int,type:string,ref:string,tokens:bigint>>").alias("refs"),
        F.lit(0).cast("long").alias("tokens"),
    )
    told = lambda acc: F.concat(acc["out"], F.array(escape(F.array_join(acc["run"], ""))))
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        is_text = F.coalesce(part["type"], F.lit("text")) == "text"
        number = first + F.size(acc["refs"])
        place = F.concat(F.lit("<|"), escape(F.coalesce(part["type"], F.lit(""))), F.lit(":"), number.cast("string"), F.lit("|>"))
        tokens = _tokens(part)
        ref = F.array(F.struct(number.alias("number"), part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens")))
        return F.struct(
            F.when(is_text, acc["out"]).otherwise(F.concat(told(acc), F.array(place))).alias("out"),
            F.when(is_text, F.concat(acc["run"], F.array(F.coalesce(part["text"], F.lit(""))))).otherwise(none).alias("run"),
            F.when(is_text, acc["refs"]).otherwise(F.concat(acc["refs"], ref)).alias("refs"),
            (acc["tokens"] + tokens).alias("tokens"),
        )

    return F.aggregate(parts, begin, step, lambda acc: F.struct(F.array_join(told(acc), "").alias("content"), acc["refs"].alias("refs"), acc["tokens"].alias("tokens")))


def format_messages(messages: DataFrame, masked: tuple[str, ...] = (ASSISTANT,)) -> DataFrame:
    """``messages``: conv_id, turn, role, parts (array of ``PART``). One row per conversation: conv_id, formatted, loss (array of
    (piece, start, end)), attachments (array of (number, type, ref, tokens)), n_tokens."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    many = F.size(F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts", many.alias("many")))).alias("m"))
    # attachments are numbered through the conversation
    firsts = F.aggregate(
        F.col("m"),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["n"] + x["many"]).alias("n"), F.concat(acc["all"], F.array(acc["n"])).alias("all")),
        lambda acc: acc["all"],
    )
    conv = conv.withColumn("firsts", F.when(F.aggregate("m", F.lit(0), lambda s, x: s + x["many"]) > 0, firsts).otherwise(F.transform("m", lambda x: F.lit(0))))
    conv = conv.withColumn("v", F.zip_with("m", "firsts", lambda x, first: F.struct(x["role"].alias("role"), _visit(x["parts"], first).alias("c"))))
    pieces = F.transform("v", lambda x: F.concat(F.lit(TURN), _role(x["role"]), F.lit("\n"), x["c"]["content"], F.lit(END)))

    def span(x: Column, i: Column) -> Column:
        start = F.length(_role(x["role"])) + len(TURN) + 1
        return F.struct(x["role"].isin(*masked).alias("on"), i.alias("piece"), start.alias("start"), (start + F.length(x["c"]["content"])).alias("end"))

    loss = F.transform(F.filter(F.transform("v", span), lambda x: x["on"]), lambda x: F.struct(x["piece"].alias("piece"), x["start"].alias("start"), x["end"].alias("end")))
    return conv.select(
        "conv_id",
        F.array_join(pieces, "").alias("formatted"),
        loss.alias("loss"),
        F.flatten(F.transform("v", lambda x: x["c"]["refs"])).alias("attachments"),
        F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["c"]["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted``'s columns with turns (array of (role, text)) and loss_text, from ``formatted`` and ``loss`` alone."""
    pieces = F.filter(F.split("formatted", f"(?=\\Q{TURN}\\E)", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(TURN) + 1), F.length(p) - len(TURN) - len(END))
        role = F.regexp_extract(body, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    out = formatted.withColumn("pieces", pieces)
    cut = F.transform("loss", lambda s: unescape(F.substring(F.get(F.col("pieces"), s["piece"]), s["start"] + 1, s["end"] - s["start"])))
    return out.select(*formatted.columns, F.transform("pieces", turn).alias("turns"), F.array_join(cut, "").alias("loss_text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_attachments."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast(own.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(own.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(ASSISTANT)).alias("role"), F.lit(probe).alias("text"),
    )
    back = read_back(format_messages(own.union(extra).select("conv_id", "turn", "role", text_message(F.col("text")).alias("parts"))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_tokens",
        F.size("attachments").cast("long").alias("n_attachments"),
    )


#: Rows by turn, then role, then text, as the operator has them; the length of the output follows from its template.
OP10_SQL = """
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, length(regexp_replace(regexp_replace(replace(text, '\\', '\\\\'), '(<)(\\||s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)', '\\1\\\\\\2', 'g'), '(\\||\\[)(>|INST\\]|/INST\\])', '\\1\\\\\\2', 'g')) as n,
    length(replace(role, '\\', '\\\\')) as r,
    len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) as w
  from rows_
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(n + r + 8 + 1 + 7) as bigint) as formatted_chars, cast(sum(w) as bigint) as n_tokens, cast(0 as bigint) as n_attachments
from escaped group by conv_id
"""
