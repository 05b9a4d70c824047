"""Chat formatting, with DataFrame functions only.

A message's content is a list of typed parts. A visitor, one branch for each type, flattens them into text with ordered
placeholders and records every attachment with its reference and the tokens that its placeholder stands for. The
template marks each turn; control strings inside texts get one more backslash, which reading takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_END = r"<\|im_end\|>\n"
#: Tokens of attachments: image patches of 28 x 28 pixels, audio by the second, documents by the page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """Roles are one line: line ends are written \\n, backslashes doubled."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def visit(part: Column) -> Column:
    """(text, type, ref, tokens) of one part: its place in the text, and what it attaches, if anything."""
    none = F.lit(None).cast("string")
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    node = lambda text, kind, ref, n: F.struct(text.alias("text"), kind.alias("type"), ref.alias("ref"), n.cast("long").alias("tokens"))
    attached = lambda kind, n: node(F.lit(f"<|{kind}|>"), F.lit(kind), F.coalesce(part["ref"], F.lit("")), F.greatest(n, F.lit(1)))
    return (
        F.when(part["type"] == "image", attached("image", patches))
        .when(part["type"] == "audio", attached("audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND)))
        .when(part["type"] == "document", attached("document", F.coalesce(part["pages"], F.lit(0)) * PER_PAGE))
        .otherwise(node(escaped(F.coalesce(part["text"], F.lit(""))), none, none, F.lit(0)))
    )


def text_parts(text: Column) -> Column:
    """One text part, for tables whose messages are plain text; a null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def flattened(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (escaped text with placeholders), attachments (type, ref, tokens, in order) of
    messages (conv_id, turn, role, parts). Null or empty parts give an empty content; null parts inside are skipped."""
    nodes = F.transform(F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p.isNotNull()), visit)
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), nodes.alias("nodes"))
    attachments = F.transform(F.filter("nodes", lambda n: n["type"].isNotNull()), lambda n: F.struct(n["type"].alias("type"), n["ref"].alias("ref"), n["tokens"].alias("tokens")))
    return rows.select("conv_id", "turn", "role", F.array_join(F.transform("nodes", lambda n: n["text"]), "").alias("content"), attachments.alias("attachments"))


def formatted(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask, attachments, attached_tokens: a row for each conversation.

    Turns go by number, null first, equal ones by role and content. mask has for each turn the code points before the
    learnt text, in it and after it; only the role `learn` has any. A conversation is one row, and so has to fit in one;
    a message without conv_id is a conversation of its own, so that such messages never gather in one task; an empty
    table gives no rows.
    """
    turn, messages = F.struct("turn", "role", "content", "attachments"), flattened(messages)
    rows = messages.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.union(messages.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    body = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(END))), "")
    n = lambda c: F.char_length(c)
    zero = F.lit(0)
    spans = lambda t: F.when(t["role"] == learn, F.struct(n(head(t)).alias("before"), n(t["content"]).alias("learnt"), F.lit(len(END)).alias("after"))).otherwise(F.struct((n(head(t)) + n(t["content"]) + len(END)).alias("before"), zero.alias("learnt"), zero.alias("after")))
    attachments = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    rows = rows.select("conv_id", body.alias("formatted"), F.transform("turns", spans).alias("mask"), attachments.alias("attachments"))
    return rows.withColumn("attached_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def turns_of(text: Column) -> Column:
    """The turns of a formatted conversation, still with their marks but for the end."""
    parts = F.split(text, _END, -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and learnt (the texts under the mask, unescaped), from formatted rows alone."""
    split = lambda s: F.struct(unescaped_role(F.substring_index(F.substr(s, F.lit(len(START) + 1)), "\n", 1)).alias("role"), unescaped(F.substr(s, F.locate("\n", s) + 1)).alias("text"))
    rows = rows.withColumn("marked", turns_of(F.col("formatted")))
    learnt = F.zip_with("marked", "mask", lambda s, m: unescaped(F.substr(s, m["before"] + 1, m["learnt"])))
    return rows.select("conv_id", "formatted", F.transform("marked", split).alias("turns"), F.filter(F.arrays_zip(learnt.alias("text"), F.col("mask").alias("m")), lambda x: x["m"]["learnt"] > 0).alias("learnt"))


def digests(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = read_back(formatted(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("learnt", lambda x: x["text"]), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
