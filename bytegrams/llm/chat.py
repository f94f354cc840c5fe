"""Chat formatting with typed content parts.

A visitor flattens the text, image, audio and document parts of each turn into
one string. Text is escaped, so no text can forge a control string, and the
escape is reversible. Other parts become placeholders in their order; their
references and expanded token counts are recorded beside the string.

A conversation is

    <|turn|>ROLE<|text|>CONTENT<|end|> <|turn|>...      (without the blank)

Escaping: each backslash is doubled, and a backslash goes in after the first
character of every control string found in a text. Unescaping drops one
backslash and keeps what follows it.

Everything is DataFrame functions; rows of one conversation meet in one
group because the result is one string per conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PARTS_TYPE = "array<struct<type:string,text:string,ref:string,units:bigint>>"


@dataclass(frozen=True)
class ChatTemplate:
    """loss_roles: whose contents are trained on. tokens_per_unit: tokens that one unit (an image tile, a second of
    audio, a page) of an attachment stands for."""

    loss_roles: tuple[str, ...] = ("assistant",)
    tokens_per_unit: dict = field(default_factory=lambda: {"image": 256, "audio": 25, "document": 512})
    #: Strings that other templates give a meaning to; they are escaped as well.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")

    def controls(self) -> list[str]:
        return [TURN, TEXT, END, *(f"<|{k}|>" for k in self.tokens_per_unit), *self.foreign]


def escape(text: Column, template: ChatTemplate) -> Column:
    controls = "|".join("\\Q" + c[1:] + "\\E" for c in template.controls())
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"([<\\[])(?={controls})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """Plain text as the only part of a content."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PARTS_TYPE)


def visit(parts: Column, template: ChatTemplate) -> Column:
    """Each part as (shown, ref, type, n_tokens); unknown types count as text."""

    def one(part: Column) -> Column:
        shown, tokens = escape(F.coalesce(part["text"], F.lit("")), template), F.lit(0).cast("long")
        attached = F.coalesce(part["type"].isin(*template.tokens_per_unit), F.lit(False))
        for kind, each in template.tokens_per_unit.items():
            is_kind = part["type"] == kind
            shown = F.when(is_kind, F.lit(f"<|{kind}|>")).otherwise(shown)
            tokens = F.when(is_kind, F.coalesce(part["units"], F.lit(1).cast("long")) * each).otherwise(tokens)
        return F.struct(shown.alias("shown"), F.when(attached, part["ref"]).alias("ref"), F.when(attached, part["type"]).alias("type"), tokens.alias("n_tokens"))

    return F.transform(F.coalesce(parts, F.array().cast(PARTS_TYPE)), one)


def format_chat(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """turns (conv_id, turn, role, and text or parts) -> one row per conversation.

    Returns conv_id, formatted, loss_spans array<struct<start,length>> (code
    points of formatted whose contents are trained on), attachments
    array<struct<turn,place,type,ref,n_tokens>> in their order.

    Null text, null parts and null role are empty. Rows with the same turn
    stay, ordered by role, then content. A null conv_id is a conversation of
    its own, a null turn comes first. No rows: no rows. Very long texts stay
    whole; a conversation is one row, so its texts must fit into one. Further
    columns are ignored.
    """
    template = template or ChatTemplate()
    parts = F.col("parts").cast(PARTS_TYPE) if "parts" in turns.columns else text_part(F.col("text"))
    role = F.coalesce(F.col("role"), F.lit(""))
    shown = turns.select(
        F.col("conv_id"), F.col("turn"), role.alias("role"), visit(parts, template).alias("visited")
    ).select(
        "conv_id",
        F.struct(
            "turn", "role",
            F.concat(F.lit(TURN), escape(F.col("role"), template), F.lit(TEXT)).alias("head"),
            F.array_join(F.col("visited.shown"), "").alias("content"),
            F.filter(F.transform("visited", lambda p, k: F.struct(k.cast("long").alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))), lambda p: p["type"].isNotNull()).alias("attached"),
        ).alias("row"),
    )
    whole = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    size = lambda r: F.length(r["head"]) + F.length(r["content"]) + len(END)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, r: Column) -> Column:
        span = F.struct((acc["at"] + F.length(r["head"])).cast("long").alias("start"), F.length(r["content"]).cast("long").alias("length"))
        return F.struct((acc["at"] + size(r)).cast("long").alias("at"), F.when(r["role"].isin(*template.loss_roles), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return whole.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("rows", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct(r["turn"].alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, turns array<struct<role,text>>, loss_text, formatted_chars."""
    pieces = F.split("formatted", "\\Q" + TURN + "\\E", -1)
    bodies = F.slice(pieces, F.lit(2), F.size(pieces))  # before the first mark there is nothing
    turn = lambda s: F.struct(unescape(F.substring_index(s, TEXT, 1)).alias("role"), unescape(F.regexp_replace(F.regexp_replace(s, "(?s)^.*?\\Q" + TEXT + "\\E", ""), "\\Q" + END + "\\E$", "")).alias("text"))
    return formatted.select(
        "conv_id",
        F.transform(bodies, turn).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle(forged: str) -> str:
    """DuckDB SQL for the digests of conversations and of a conversation -7 with that text; each escape adds one character."""
    controls = "|".join(re.escape(c) for c in ChatTemplate().controls())
    size = lambda x: f"len(regexp_replace(replace({x}, '\\', '\\\\'), '({controls})', '\\1+', 'g'))"
    marks = len(TURN) + len(TEXT) + len(END)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
UNION ALL SELECT -7, 0, 'user', '{forged}' UNION ALL SELECT -7, 1, 'assistant', '{forged}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(len(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + {size('r')} + {size('x')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""
